"""Readers: every source ends in a typed DataFrame, with bad records set apart instead of failing the job.

Schemas are explicit, paths may be any URI that Spark reads, and nothing is read on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions.text import nonempty, number, parse_time
from duskwatch.operators.filters import good_and_bad, validity_error
from duskwatch.operators.windows import latest

# Maps of external names to ours.
PROTOCOLS = {"6": "TCP", "17": "UDP", "1": "ICMP", "tcp": "TCP", "udp": "UDP", "icmp": "ICMP"}
OBJECTS = {"PROCESS": "process", "FILE": "file", "FLOW": "network", "FLOW-START": "network", "FLOW-END": "network", "REGISTRY": "registry", "USER_SESSION": "auth", "THREAD": "process"}
ECAR_ACTIONS = {
    "CREATE": "create", "TERMINATE": "terminate", "OPEN": "open", "READ": "read", "WRITE": "write", "DELETE": "delete", "MODIFY": "modify", "RENAME": "rename", "ENCRYPT": "encrypt",
    "CONNECT": "connect", "START": "connect", "END": "disconnect", "SEND": "send", "RECEIVE": "receive", "LOGIN": "login", "LOGOUT": "logout", "ESCALATE": "escalate",
    "ADD_KEY": "create", "EDIT_KEY": "modify", "REMOVE_KEY": "delete",
}
BOTNET_WORDS = ("botnet", "malware", "c&c", "cc", "cnc")
HONEYPOT_EVENTS = {"cowrie": "auth", "dionaea": "file", "honeytrap": "network", "suricata": "network"}
ECAR = "timestamp long, id string, hostname string, objectID string, object string, action string, actorID string, pid long, ppid long, tid long, principal string, properties map<string,string>"
STIX = (
    "type string, name string, description string, external_references array<struct<source_name:string,external_id:string>>, "
    "kill_chain_phases array<struct<kill_chain_name:string,phase_name:string>>, x_mitre_platforms array<string>, x_mitre_is_subtechnique boolean, x_mitre_version string"
)
HONEYPOT = (
    "timestamp string, `@timestamp` string, type string, src_ip string, src_port int, dest_ip string, dest_port int, protocol string, "
    "username string, password string, input string, session string, file_name string, sha256_hash string"
)
CAPTURE = "event_type string, timestamp string, source_system string, event_data map<string,string>"


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file of one array or one object; array elements become rows."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of a file with one JSON object a line; splittable, so it scales with the file."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").isNotNull().alias("ok"))
    return parsed.filter("ok").select("r.*"), parsed.filter("not ok").select("value")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; all columns are strings and their names are trimmed."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def flows_by_duration(df: DataFrame) -> DataFrame:
    """Flow records with a label per flow: times are local text, bytes received is what isn't sent."""
    label = F.when(F.contains("Label", F.lit("flow=")), F.trim(F.split_part("Label", F.lit("flow="), F.lit(2)))).otherwise(F.trim("Label"))
    sent, total = number(F.col("SrcBytes")), number(F.col("TotBytes"))
    botnet = F.lit(False)
    for word in BOTNET_WORDS:
        botnet = botnet | F.lower(label).contains(word)
    return df.select(
        F.lit("network").alias("event_type"),
        parse_time(F.col("StartTime")).alias("ts"),
        number(F.col("Dur")).alias("duration_s"),
        F.upper("Proto").alias("protocol"),
        F.col("SrcAddr").alias("src_ip"),
        number(F.col("Sport")).cast("int").alias("src_port"),
        F.col("DstAddr").alias("dst_ip"),
        number(F.col("Dport")).cast("int").alias("dst_port"),
        number(F.col("TotPkts")).cast("long").alias("packets"),
        sent.cast("long").alias("bytes_sent"),
        F.greatest(total - sent, F.lit(0.0)).cast("long").alias("bytes_received"),
        label.alias("label"),
        botnet.alias("botnet"),
    )


def flows_by_direction(df: DataFrame) -> DataFrame:
    """Flow records with forward and backward counts, durations in microseconds and TCP flag counts."""
    col = lambda *names: F.coalesce(*[F.col(f"`{n}`") for n in names if n in df.columns] or [F.lit(None).cast("string")])
    flags = [c for c in df.columns if c.endswith("Flag Count")]
    return df.select(
        F.lit("network").alias("event_type"),
        parse_time(col("Timestamp")).alias("ts"),
        (number(col("Flow Duration")) / 1e6).alias("duration_s"),
        F.coalesce(lookup(PROTOCOLS, F.lower(F.trim(col("Protocol")))), F.lit("OTHER")).alias("protocol"),
        col("Source IP", "Src IP").alias("src_ip"),
        number(col("Source Port", "Src Port")).cast("int").alias("src_port"),
        col("Destination IP", "Dst IP").alias("dst_ip"),
        number(col("Destination Port", "Dst Port")).cast("int").alias("dst_port"),
        (number(col("Total Fwd Packets")) + number(col("Total Backward Packets"))).cast("long").alias("packets"),
        number(col("Total Length of Fwd Packets")).cast("long").alias("bytes_sent"),
        number(col("Total Length of Bwd Packets")).cast("long").alias("bytes_received"),
        F.map_from_arrays(F.array(*map(F.lit, flags)), F.array(*[number(F.col(f"`{f}`")).cast("long") for f in flags])).alias("flags") if flags else F.lit(None).alias("flags"),
        F.trim(col("Label")).alias("label"),
    )


def process_name(name: Column, path: Column, command: Column) -> Column:
    base = lambda c: F.nullif(F.regexp_extract(c, r"([^\\/]+)$", 1), F.lit(""))
    return F.coalesce(nonempty(name), base(path), base(F.split_part(command, F.lit(" "), F.lit(1))))


def ecar_events(df: DataFrame) -> DataFrame:
    p = lambda k: F.try_element_at("properties", F.lit(k))
    return df.select(
        F.col("id").alias("event_id"),
        F.timestamp_millis("timestamp").alias("ts"),
        F.coalesce(lookup(OBJECTS, F.upper("object")), F.lit("process")).alias("event_type"),
        F.coalesce(lookup(ECAR_ACTIONS, F.upper("action")), F.lower("action")).alias("action"),
        F.col("hostname").alias("host"),
        F.col("principal").alias("user_name"),
        "pid",
        "ppid",
        process_name(p("name"), p("image_path"), p("command_line")).alias("process_name"),
        p("command_line").alias("command"),
        p("src_ip").alias("src_ip"),
        p("dest_ip").alias("dst_ip"),
        p("file_path").alias("file_path"),
    )


def techniques(df: DataFrame) -> DataFrame:
    """Technique records: id from the first reference of the source, tactics of the kill chain; last of an id wins."""
    rows = df.filter("type = 'attack-pattern'").withColumn("__seq", F.monotonically_increasing_id())
    refs = F.filter("external_references", lambda r: r["source_name"] == "mitre-attack")
    phases = F.filter("kill_chain_phases", lambda p: p["kill_chain_name"] == "mitre-attack")
    out = rows.select(
        F.get(refs, 0)["external_id"].alias("technique_id"),
        "name",
        "description",
        F.transform(phases, lambda p: p["phase_name"]).alias("tactics"),
        F.col("x_mitre_platforms").alias("platforms"),
        F.coalesce("x_mitre_is_subtechnique", F.lit(False)).alias("is_subtechnique"),
        "__seq",
    )
    return latest(out.filter("technique_id is not null"), ["technique_id"], [F.desc("__seq")]).drop("__seq")


def read_stix(spark: SparkSession, path: str) -> DataFrame:
    """Bundles, or a folder of single objects."""
    df = spark.read.option("multiLine", True).option("recursiveFileLookup", True).schema(f"{STIX}, objects array<struct<{_as_struct(STIX)}>>").json(path)
    inner = df.filter("objects is not null").select(F.explode("objects").alias("o")).select("o.*")
    return techniques(df.filter("objects is null").drop("objects").unionByName(inner))


def _as_struct(schema: str) -> str:
    out, depth, fields = "", 0, []
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = out.strip().split(" ", 1)
            fields.append(f"{name}:{kind}")
            out = ""
        else:
            out += c
    return ",".join(fields)


def inner_text(xml: Column) -> Column:
    """Text of an element whose inner elements, as in catalogues, have a prefix (``<xhtml:p>``): their tags go, their text stays.

    The reader has resolved entities before, so signs that were escaped, such as ``<b>``, are text and stay.
    """
    return F.regexp_replace(F.regexp_replace(xml, r"</?[A-Za-z_][\w.-]*:[A-Za-z_][^<>]*>", ""), r"^\s+|\s+$", "")


def read_capec(spark: SparkSession, path: str) -> DataFrame:
    """Attack patterns of an XML catalogue, last of an id wins. A description's text counts with that of elements inside it."""
    schema = "_ID string, _Name string, Description string, Typical_Severity string, Likelihood_Of_Attack string"
    df = spark.read.format("xml").option("rowTag", "Attack_Pattern").schema(schema).load(path).withColumn("__seq", F.monotonically_increasing_id())
    out = df.select(F.concat(F.lit("CAPEC-"), "_ID").alias("capec_id"), F.col("_Name").alias("name"), inner_text(F.col("Description")).alias("description"),
                    F.col("Typical_Severity").alias("severity"), F.col("Likelihood_Of_Attack").alias("likelihood"), "__seq")
    return latest(out, ["capec_id"], [F.desc("__seq")]).drop("__seq")


def vulnerabilities(df: DataFrame) -> DataFrame:
    """Known exploited vulnerabilities by id, last wins; weaknesses as a list."""
    rows = df.withColumn("__seq", F.monotonically_increasing_id())
    out = rows.select(
        F.upper(F.trim("cveID")).alias("cve_id"),
        F.col("vendorProject").alias("vendor"),
        "product",
        F.to_date(F.col("dateAdded").try_cast("date")).alias("date_added"),
        F.to_date(F.col("dueDate").try_cast("date")).alias("due_date"),
        (F.lower("knownRansomwareCampaignUse") == "known").alias("ransomware"),
        F.filter(F.transform(F.split(F.coalesce("cwes", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "").alias("cwes"),
        "__seq",
    )
    return latest(out, ["cve_id"], [F.desc("__seq")]).drop("__seq")


def honeypot_events(df: DataFrame) -> DataFrame:
    return df.select(*_honeypot_columns())


def _honeypot_columns() -> list[Column]:
    kind = F.coalesce(lookup(HONEYPOT_EVENTS, F.lower("type")), F.lit("network"))
    kind = F.when(nonempty(F.col("input")).isNotNull(), F.lit("process")).when(nonempty(F.col("sha256_hash")).isNotNull(), F.lit("file")).otherwise(kind)
    severity = F.when(nonempty(F.col("sha256_hash")).isNotNull() | F.contains(F.lower(F.coalesce("input", F.lit(""))), F.lit("wget")), "CRITICAL").when(
        F.col("dest_port").isin(22, 23, 445, 3389), "HIGH"
    ).otherwise("MEDIUM")
    return [
        parse_time(F.coalesce("timestamp", "@timestamp")).alias("ts"), kind.alias("event_type"), F.lower("type").alias("sensor"), "src_ip", "src_port", F.col("dest_ip").alias("dst_ip"),
        F.col("dest_port").alias("dst_port"), F.upper("protocol").alias("protocol"), F.col("username").alias("user_name"), F.col("input").alias("command"), F.col("sha256_hash").alias("file_hash"),
        F.substring("input", 1, 100).alias("payload"), severity.alias("severity"), F.lit("TPOT").alias("source_mode"),
    ]


def syslog_events(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Syslog lines: the JSON behind an optional header, else the raw line. Lines are read once for both."""
    body = F.regexp_extract(text_col, r"(\{.*)", 1)
    parsed = F.from_json(body, HONEYPOT)
    ok = F.try_parse_json(body).isNotNull() & (body != "")
    rows = lines.select(F.col(text_col).alias("__raw"), parsed.alias("__r"), ok.alias("__ok")).select("__raw", "__ok", "__r.*")
    both = rows.select("__raw", "__ok", *_honeypot_columns())
    bare = {"command": F.col("__raw"), "event_type": F.lit("syslog"), "source_mode": F.lit("TPOT")}
    return both.select(*[F.when(F.col("__ok"), F.col(c)).otherwise(bare.get(c)).alias(c) for c in both.columns[2:]])


def capture_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events in order of time, rejected with their error): types and required fields are checked row by row."""
    d = lambda k: F.try_element_at("event_data", F.lit(k))
    rows = df.select(
        F.lower("event_type").alias("event_type"), parse_time(F.col("timestamp")).alias("ts"), "source_system", F.lower(d("action")).alias("action"), d("pid").try_cast("long").alias("pid"),
        d("user").alias("user_name"), d("command").alias("command"), d("path").alias("file_path"), F.coalesce(d("destination"), d("ip")).alias("dst_ip"), d("domain").alias("domain"), "event_data",
    )
    kinds = F.col("event_type").isin("process", "file", "network", "auth", "registry", "user")
    needs = {"process": "pid", "file": "file_path", "auth": "user_name"}
    missing = F.coalesce(*[F.when((F.col("event_type") == k) & F.col(c).isNull(), F.lit(f"{k} without {c}")) for k, c in needs.items()])
    error = F.coalesce(validity_error({"timestamp": F.col("ts"), "action": F.col("action")}), F.when(~kinds, F.lit("unknown event type")), missing)
    good, bad = good_and_bad(rows, error)
    return good.orderBy("ts"), bad


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of files, for hash look-ups."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


FORMATS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flow_duration": lambda s, p: flows_by_duration(read_csv(s, p)),
    "flow_direction": lambda s, p: flows_by_direction(read_csv(s, p)),
    "ecar": lambda s, p: ecar_events(read_jsonl(s, p, ECAR)[0]),
    "stix": read_stix,
    "capec": read_capec,
    "kev": lambda s, p: vulnerabilities(read_csv(s, p)),
    "honeypot_array": lambda s, p: honeypot_events(read_json(s, p, HONEYPOT)),
    "honeypot": lambda s, p: honeypot_events(read_jsonl(s, p, HONEYPOT)[0]),
    "capture": lambda s, p: capture_events(read_json(s, p, CAPTURE))[0],
}


def read(spark: SparkSession, kind: str, path: str, limit: int | None = None) -> DataFrame:
    """A data set of a registered format."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; known are {', '.join(sorted(FORMATS))}")
    df = FORMATS[kind](spark, path)
    return df.limit(limit) if limit is not None else df
