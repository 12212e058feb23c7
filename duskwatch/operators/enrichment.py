"""Profiles with what threat intelligence knows about them: techniques, attack patterns, malware feeds, vulnerabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .knowledge import pattern_matches
from .matching import substring_matches
from .steps import stored

# The vulnerability named if nothing matches, and from which novelty on vulnerabilities are looked up.
DEFAULT_CVE, NOVEL = "CVE-2026-48908", 0.8
# How many techniques and vulnerabilities are enough, and how long a hash is.
ENOUGH_TECHNIQUES, ENOUGH_CVES, HASH_CHARS = 5, 3, 64


def _first(held: DataFrame, most: int) -> DataFrame:
    """(word, found): of each word its first ``most`` ids."""
    w = Window.partitionBy("word").orderBy("id")
    few = held.distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return few.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("found"))


def _filled(asked: DataFrame, key: str, most: int) -> DataFrame:
    """(key, ids): what the words of a key found, word by word, until there are ``most``; each word adds one at least if it can.

    ``asked`` has (key, at, found, exact); what an exact word found is added whatever there is.
    """
    step = lambda acc, x: F.concat(acc, F.when(x["exact"], x["found"]).otherwise(F.slice(x["found"], F.lit(1), F.greatest(F.lit(1), F.lit(most) - F.size(acc)))))
    start = F.array().cast("array<string>")
    parts = F.array_sort(F.collect_list(F.struct("at", "exact", "found")))
    return asked.filter(F.size("found") > 0).groupBy(key).agg(F.aggregate(parts, start, step).alias("ids"))


def _terms(column: str, key: str, profiles: DataFrame, value: Column) -> DataFrame:
    return profiles.select(key, F.posexplode(column).alias("at", "term")).select(key, "at", value.alias("term"))


def techniques_of(profiles: DataFrame, key: str, techniques: DataFrame) -> DataFrame:
    """(key, mitre_techniques): the named techniques, unknown ones by their id; without any, those whose tactics hold a category of the intent.

    ``profiles`` has arrays ``techniques`` and ``intents`` in order of rank, ``techniques`` (technique_id, name, tactics).
    """
    named = _terms("techniques", key, profiles, F.col("term")).join(techniques.select(F.col("technique_id").alias("term"), "name"), "term", "left")
    entry = F.struct(F.col("term").alias("technique_id"), F.coalesce("name", F.concat(F.lit("Technique "), "term")).alias("name"))
    direct = named.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", entry.alias("e")))), lambda x: x["e"]).alias("mitre_techniques"))
    bare = profiles.filter(F.coalesce(F.size("techniques"), F.lit(0)) <= 0)
    words = stored(_terms("intents", key, bare, F.replace(F.lower("term"), F.lit("_"), F.lit(" "))), "intents")
    tactics = techniques.select(F.explode("tactics").alias("t"), F.col("technique_id").alias("id"), "name").withColumn("t", F.lower("t"))
    different = tactics.select("t").distinct()
    held = substring_matches(different.select("t", F.col("t").alias("text")), "t", "text", words, "term").join(tactics, "t").select("word", "id")
    some = words.join(_first(held, ENOUGH_TECHNIQUES), F.col("term") == F.col("word")).select(key, "at", "found", F.lit(False).alias("exact"))
    ids = _filled(some, key, ENOUGH_TECHNIQUES).select(key, F.posexplode("ids").alias("at", "technique_id")).join(techniques.select("technique_id", "name"), "technique_id")
    guessed = ids.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.struct("technique_id", "name").alias("e")))), lambda x: x["e"]).alias("mitre_techniques"))
    return direct.unionByName(guessed)


def vulnerabilities_of(profiles: DataFrame, key: str, vulnerabilities: DataFrame, default: str = DEFAULT_CVE) -> DataFrame:
    """(key, related_vulnerabilities) of profiles that are novel or have metadata: ids by the values of the metadata in order.

    A value with "CVE-" names one by its first word, another of more than three characters those whose product or vendor
    holds it, by id, until there are three; a value adds one at least. If none is found, the default if it exists.
    """
    asked = profiles.filter((F.coalesce("novelty", F.lit(0.0)) > NOVEL) | (F.coalesce(F.size("metadata"), F.lit(0)) > 0))
    values = _terms("values", key, asked.withColumn("values", F.map_values("metadata")), F.col("term")).filter((F.length("term") > 3) & (F.trim("term") != ""))
    is_id = F.contains("term", F.lit("CVE-"))
    terms = stored(values.withColumn("exact", is_id).withColumn("term", F.when(is_id, F.element_at(F.split(F.trim("term"), r"\s+"), 1)).otherwise(F.lower(F.trim("term")))), "terms")
    known = vulnerabilities.select(F.col("cve_id").alias("id"), F.lower(F.concat_ws("\n", "product", "vendor")).alias("text"))
    by_id = known.select(F.col("id").alias("word"), F.array("id").alias("found")).distinct()
    by_name = _first(substring_matches(known, "id", "text", terms.filter("not exact"), "term"), ENOUGH_CVES)
    found = terms.filter("exact").join(by_id, F.col("term") == F.col("word")).unionByName(terms.filter("not exact").join(by_name, F.col("term") == F.col("word")))
    ids = _filled(found.select(key, "at", "found", "exact"), key, ENOUGH_CVES)
    general = known.filter(F.col("id") == default).agg(F.array_distinct(F.collect_list("id")).alias("general"))  # one row
    return asked.select(key).join(ids, key, "left").crossJoin(F.broadcast(general)).select(key, F.coalesce("ids", "general").alias("related_vulnerabilities"))


def malware_of(profiles: DataFrame, key: str, hashes: DataFrame, addresses: DataFrame) -> DataFrame:
    """(key, malware_correlation) of profiles with a hash in their metadata or features: what the feeds say of that hash and of the remote address.

    ``hashes`` has (sha256, signature), ``addresses`` (ip, status), one row a value.
    """
    meta = lambda k: F.nullif(F.try_element_at("metadata", F.lit(k)), F.lit(""))
    feature = F.get(F.filter("features", lambda x: F.length(x) == HASH_CHARS), 0)
    held = F.coalesce(F.map_contains_key("metadata", "hash") | F.map_contains_key("metadata", "sha256"), F.lit(False)) | feature.isNotNull()
    rows = profiles.filter(held).select(key, F.coalesce(meta("hash"), meta("sha256"), feature).alias("sha256"), F.try_element_at("metadata", F.lit("dest_ip")).alias("ip"))
    both = rows.join(hashes.select("sha256", "signature"), "sha256", "left").join(addresses.select("ip", "status"), "ip", "left")
    entry = lambda feed, indicator, says: F.when(F.col(says).isNotNull(), F.struct(F.lit(feed).alias("feed"), F.col(indicator).alias("indicator"), F.col(says).alias("says")))
    return both.select(key, F.array_compact(F.array(entry("hash", "sha256", "signature"), entry("address", "ip", "status"))).alias("malware_correlation"))


def enrich(profiles: DataFrame, key: str, techniques: DataFrame, patterns: DataFrame, vulnerabilities: DataFrame, hashes: DataFrame, addresses: DataFrame, default: str = DEFAULT_CVE) -> DataFrame:
    """Each profile with four arrays of context, null where a source doesn't apply; vulnerabilities are empty then.

    ``profiles`` has unique keys, ``techniques``, ``intents``, ``features`` and ``critical_path`` (arrays), ``metadata`` (a map)
    and ``novelty``. Profiles without features and path are compared with no attack pattern.
    """
    profiles = stored(profiles, "profiles")
    words = F.explode(F.concat(F.coalesce("features", F.array().cast("array<string>")), F.coalesce("critical_path", F.array().cast("array<string>"))))
    ranked = pattern_matches(profiles.select(key, words.alias("keyword")), key, patterns)
    attack = ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pattern_id"))), lambda x: x["pattern_id"]).alias("capec_patterns"))
    out = profiles
    for part in (techniques_of(profiles, key, techniques), attack, malware_of(profiles, key, hashes, addresses), vulnerabilities_of(profiles, key, vulnerabilities, default)):
        out = out.join(part, key, "left")
    return out.withColumn("related_vulnerabilities", F.coalesce("related_vulnerabilities", F.array().cast("array<string>")))
