"""Queries of readers and stored documents: files are written from the tables, read back, and compared with SQL over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.operators import sinks
from duskwatch.operators.steps import shared_dir
from duskwatch.sources import documents, readers, telemetry_events

from .registry import register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _csv(df: DataFrame, name: str) -> str:
    path = _folder(df.sparkSession, name)
    df.write.option("header", True).csv(path)
    return path


def _lines(df: DataFrame, line: Column, name: str) -> str:
    path = _folder(df.sparkSession, name)
    df.select(line.alias("value")).write.text(path)
    return path


def _file_each(df: DataFrame, key: Column, text: Column, name: str) -> str:
    """A file for each key, with one line; keys are unique."""
    path = _folder(df.sparkSession, name)
    write_each(df.select(key.alias("k"), text.alias("value")), path)
    return path


def write_each(lines: DataFrame, path: str) -> None:
    """(k, value) as a folder and file for each k, by a fixed number of tasks: small files are few bytes, which Spark would give to one task."""
    tasks = 4 * lines.sparkSession.sparkContext.defaultParallelism
    # tasks move their files themselves; the default leaves that to the driver, one file after another
    lines.repartition(tasks, "k").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("k").text(path)


def _arrays(df: DataFrame, key: Column, record: Column, name: str, wrap: str = "%s") -> str:
    """A file for each key with the JSON array of its records; keys name a bounded number of rows."""
    grouped = df.groupBy(key.alias("key")).agg(F.to_json(F.collect_list(record)).alias("body"))
    return _files(grouped, F.format_string(wrap, "body"), name)


def _files(df: DataFrame, text: Column, name: str) -> str:
    """A file for each row, with one line."""
    path = _folder(df.sparkSession, name)
    write_apart(df.select(text.alias("value")), path)
    return path


def write_apart(lines: DataFrame, path: str) -> None:
    """A file for each (value), all in one folder: listing folders of one file each takes a task for every folder."""
    tasks = 4 * lines.sparkSession.sparkContext.defaultParallelism
    lines.repartition(tasks, "value").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").option("maxRecordsPerFile", 1).text(path)


@register(
    "reader_flows_by_duration",
    """
    SELECT event_id, 'network' AS event_type, ts, value / 10 AS duration_s, CASE event_id % 2 WHEN 0 THEN 'TCP' ELSE 'UDP' END AS protocol, '10.0.0.' || (user_id % 200) AS src_ip,
      CASE WHEN event_id % 9 > 0 THEN 1024 + event_id % 1000 ELSE 0 END::INTEGER AS src_port, CAST(event_id AS VARCHAR) AS dst_ip, 443 AS dst_port, (event_id % 50)::BIGINT AS packets,
      (user_id * 3)::BIGINT AS bytes_sent, greatest(event_id - user_id * 3, 0)::BIGINT AS bytes_received, CASE event_id % 4 WHEN 0 THEN 'From-Botnet-V1' WHEN 1 THEN 'Background' ELSE 'Normal CC' END AS label, event_id % 4 <> 1 AS botnet
    FROM events
    """,
)
def reader_flows_by_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as flow records in CSV."""
    e, i = _t(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select(
        F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSSSSS").alias("StartTime"), (F.col("value") / 10).alias("Dur"), F.when(i % 2 == 0, "tcp").otherwise("udp").alias("Proto"),
        F.format_string("10.0.0.%d", F.col("user_id") % 200).alias("SrcAddr"), F.when(i % 9 > 0, (1024 + i % 1000).cast("string")).otherwise("zz").alias("Sport"), i.alias("DstAddr"), F.lit(443).alias("Dport"),
        (i % 50).alias("TotPkts"), i.alias("TotBytes"), (F.col("user_id") * 3).alias("SrcBytes"), F.when(i % 4 == 0, "flow=From-Botnet-V1").when(i % 4 == 1, " Background").otherwise("flow=Normal CC").alias("Label"),
    )
    return readers.read(spark, "flow_duration", _csv(rows, "flows")).withColumn("event_id", F.col("dst_ip").cast("long"))


@register(
    "reader_flows_by_direction",
    """
    SELECT event_id, 'network' AS event_type, date_trunc('second', ts) AS ts, value AS duration_s, CASE event_id % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE 'OTHER' END AS protocol, (event_id % 7 + event_id % 11)::BIGINT AS packets,
      (user_id * 2)::BIGINT AS bytes_sent, user_id::BIGINT AS bytes_received, (event_id % 2)::BIGINT AS syn, CASE event_id % 2 WHEN 0 THEN 'BENIGN' ELSE 'DoS' END AS label FROM events
    """,
)
def reader_flows_by_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as flow records with counts for each direction; names in the header start with a blank."""
    i = F.col("event_id")
    rows = _t(spark, sf_dir, "events").select(
        F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias(" Timestamp"), i.alias(" Source IP"), F.when(i % 3 == 0, "6").when(i % 3 == 1, "17").otherwise("88").alias(" Protocol"),
        (F.col("value") * 1e6).alias(" Flow Duration"), (i % 7).alias(" Total Fwd Packets"), (i % 11).alias(" Total Backward Packets"), (F.col("user_id") * 2).alias("Total Length of Fwd Packets"),
        F.col("user_id").alias(" Total Length of Bwd Packets"), (i % 2).alias(" SYN Flag Count"), F.when(i % 2 == 0, " BENIGN").otherwise("DoS ").alias(" Label"),
    )
    got = readers.read(spark, "flow_direction", _csv(rows, "directions"))
    return got.select(
        F.col("src_ip").cast("long").alias("event_id"), "event_type", "ts", F.round("duration_s", 6).alias("duration_s"), "protocol", "packets", "bytes_sent", "bytes_received",
        F.col("flags")["SYN Flag Count"].alias("syn"), "label",
    )


@register(
    "reader_ecar",
    """
    SELECT event_id, date_trunc('millisecond', ts) AS ts, CASE event_type WHEN 'view' THEN 'process' WHEN 'click' THEN 'network' WHEN 'error' THEN 'registry' ELSE 'process' END AS event_type,
      CASE event_type WHEN 'click' THEN 'connect' WHEN 'error' THEN 'modify' WHEN 'view' THEN 'create' ELSE 'odd' END AS action, 'host-' || (user_id % 20) AS host, user_id::BIGINT AS pid,
      CASE WHEN event_type = 'view' THEN 'run' || (event_id % 5) || '.exe' END AS process_name, CASE WHEN event_type = 'click' THEN '8.8.8.' || (event_id % 9) END AS dst_ip FROM events WHERE event_id % 50 > 0
    UNION ALL SELECT event_id, NULL, 'bad line', NULL, NULL, NULL, NULL, NULL FROM events WHERE event_id % 50 = 0
    """,
)
def reader_ecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines of objects and actions, every fiftieth cut short: bad lines come back as such."""
    i, kind = F.col("event_id"), F.col("event_type")
    record = F.to_json(F.struct(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), i.cast("string").alias("id"), F.format_string("host-%d", F.col("user_id") % 20).alias("hostname"), F.col("user_id").alias("pid"),
        F.when(kind == "view", "PROCESS").when(kind == "click", "flow").when(kind == "error", "REGISTRY").otherwise("SOMETHING").alias("object"),
        F.when(kind == "view", "CREATE").when(kind == "click", "START").when(kind == "error", "EDIT_KEY").otherwise("ODD").alias("action"),
        F.create_map(F.lit("image_path"), F.when(kind == "view", F.format_string("C:\\Windows\\run%d.exe", i % 5)), F.lit("dest_ip"), F.when(kind == "click", F.format_string("8.8.8.%d", i % 9))).alias("properties"),
    ))
    path = _lines(_t(spark, sf_dir, "events"), F.when(i % 50 == 0, F.format_string('{"id": %d, "object"', i)).otherwise(record), "ecar")
    good, bad = readers.read_jsonl(spark, path, readers.ECAR)
    rows = readers.ecar_events(good).select(F.col("event_id").cast("long").alias("event_id"), "ts", "event_type", "action", "host", "pid", "process_name", "dst_ip")
    lost = bad.select(F.regexp_extract("value", r"(\d+)", 1).cast("long").alias("event_id"), F.lit("bad line").alias("event_type"))
    return rows.unionByName(lost, allowMissingColumns=True)


@register(
    "reader_stix",
    """
    SELECT 'T' || p_partkey AS technique_id, p_name AS name, p_type AS description, CASE p_size % 2 WHEN 0 THEN 'execution' ELSE 'impact' END AS tactics, 'Linux' AS platforms, p_partkey % 3 = 0 AS is_subtechnique FROM part WHERE p_partkey % 10 > 0
    UNION ALL SELECT 'S' || s_suppkey, s_name, NULL, 'execution', NULL, false FROM supplier
    """,
)
def reader_stix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as techniques in bundles, every tenth another kind of object; suppliers as files of one technique."""

    def technique(kind: Column, key: Column, name: str, text: Column, tactic: Column, **more: Column) -> Column:
        other = F.struct(F.lit("other").alias("source_name"), F.lit("x").alias("external_id"))
        refs = F.array(other, F.struct(F.lit("mitre-attack").alias("source_name"), key.alias("external_id")))
        phases = F.array(F.struct(F.lit("mitre-attack").alias("kill_chain_name"), tactic.alias("phase_name")), F.struct(F.lit("own").alias("kill_chain_name"), F.lit("x").alias("phase_name")))
        return F.struct(kind.alias("type"), F.col(name).alias("name"), text.alias("description"), refs.alias("external_references"), phases.alias("kill_chain_phases"), *[c.alias(n) for n, c in more.items()])

    k = F.col("p_partkey")
    item = technique(
        F.when(k % 10 > 0, "attack-pattern").otherwise("malware"), F.concat(F.lit("T"), k), "p_name", F.col("p_type"), F.when(F.col("p_size") % 2 == 0, "execution").otherwise("impact"),
        x_mitre_platforms=F.array(F.lit("Linux")), x_mitre_is_subtechnique=k % 3 == 0,
    )
    bundles = _arrays(_t(spark, sf_dir, "part"), F.floor(k / 500), item, "stix", '{"type": "bundle",\n"objects": %s}')
    single = technique(F.lit("attack-pattern"), F.concat(F.lit("S"), F.col("s_suppkey")), "s_name", F.lit(None).cast("string"), F.lit("execution"))
    singles = _files(_t(spark, sf_dir, "supplier"), F.to_json(single), "stix")
    got = readers.read(spark, "stix", bundles).unionByName(readers.read(spark, "stix", singles))
    return got.withColumns({c: F.array_join(c, ",") for c in ("tactics", "platforms")})


@register(
    "reader_capec",
    """
    SELECT 'CAPEC-' || p_partkey AS capec_id, p_name AS name, p_type || ' of ' || p_brand || ' <b> & more' AS description, CASE p_size % 2 WHEN 0 THEN 'High' END AS severity, 'Low' AS likelihood FROM part
    """,
)
def reader_capec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as an XML catalogue, descriptions with elements and escaped signs inside."""
    line = F.format_string(
        '<Attack_Pattern ID="%d" Name="%s"><Description>\n%s <xhtml:p class="x">of %s</xhtml:p> &lt;b&gt; &amp; more </Description>%s<Likelihood_Of_Attack>Low</Likelihood_Of_Attack></Attack_Pattern>',
        "p_partkey", "p_name", "p_type", "p_brand", F.when(F.col("p_size") % 2 == 0, "<Typical_Severity>High</Typical_Severity>").otherwise(""),
    )
    catalogues = _t(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 5000).alias("k")).agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    text = F.concat(F.lit('<Catalog xmlns:xhtml="http://www.w3.org/1999/xhtml">'), "body", F.lit("</Catalog>"))
    return readers.read(spark, "capec", _files(catalogues, text, "capec"))


@register(
    "reader_known_vulnerabilities",
    """
    SELECT 'CVE-2024-' || p_partkey AS cve_id, p_brand AS vendor, p_name AS product, DATE '2024-01-01' + (p_size)::INTEGER AS date_added, CASE WHEN p_size % 3 > 0 THEN DATE '2024-06-01' END AS due_date, p_size % 2 = 0 AS ransomware,
      CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'CWE-7' ELSE 'CWE-7|CWE-' || p_size END AS cwes FROM part
    """,
)
def reader_known_vulnerabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a catalogue in CSV with quoted lists."""
    k = F.col("p_size")
    rows = _t(spark, sf_dir, "part").select(
        F.format_string(" cve-2024-%d", "p_partkey").alias("cveID"), F.col("p_brand").alias("vendorProject"), F.col("p_name").alias("product"), F.date_add(F.lit("2024-01-01").cast("date"), k).alias("dateAdded"),
        F.when(k % 3 > 0, "2024-06-01").otherwise("soon").alias("dueDate"), F.when(k % 2 == 0, "Known").otherwise("Unknown").alias("knownRansomwareCampaignUse"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, "CWE-7,").otherwise(F.format_string("CWE-7, CWE-%d", k)).alias("cwes"),
    )
    return readers.read(spark, "kev", _csv(rows, "kev")).withColumn("cwes", F.array_join("cwes", "|"))


_HONEYPOT = """
    SELECT event_id, date_trunc('second', ts) AS ts, CASE WHEN event_type = 'error' THEN 'process' WHEN event_type = 'purchase' THEN 'file' WHEN event_type = 'click' THEN 'auth' ELSE 'network' END AS event_type,
      CASE event_type WHEN 'click' THEN 'cowrie' ELSE 'suricata' END AS sensor, CASE WHEN event_type IN ('purchase') OR (event_type = 'error' AND event_id % 2 = 0) THEN 'CRITICAL' WHEN event_id % 5 IN (2, 3) THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
      CASE WHEN event_type = 'error' THEN CASE event_id % 2 WHEN 0 THEN 'WGET x' ELSE 'ls' END END AS payload FROM events
"""


def _honeypot(kind: Column, i: Column) -> Column:
    return F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("@timestamp"), F.when(kind == "click", "Cowrie").otherwise("suricata").alias("type"), (20 + i % 5).alias("dest_port"), i.cast("string").alias("src_ip"),
        F.when(kind == "error", F.when(i % 2 == 0, "WGET x").otherwise("ls")).alias("input"), F.when(kind == "purchase", "ab").otherwise("").alias("sha256_hash"),
    )


def _alerts(got: DataFrame) -> DataFrame:
    return got.select(F.col("src_ip").cast("long").alias("event_id"), "ts", "event_type", "sensor", "severity", "payload")


@register("reader_honeypot_lines", _HONEYPOT)
def reader_honeypot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as honeypot alerts, one JSON object a line."""
    path = _lines(_t(spark, sf_dir, "events"), F.to_json(_honeypot(F.col("event_type"), F.col("event_id"))), "honeypot")
    return _alerts(readers.read(spark, "honeypot", path))


@register("reader_honeypot_arrays", _HONEYPOT)
def reader_honeypot_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same alerts in files of one array each."""
    path = _arrays(_t(spark, sf_dir, "events"), F.floor(F.col("event_id") / 5000), _honeypot(F.col("event_type"), F.col("event_id")), "honeypot")
    return _alerts(readers.read(spark, "honeypot_array", path))


@register(
    "reader_captures",
    """
    SELECT event_id, event_type, ts, action, error FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'process' WHEN 'click' THEN 'file' WHEN 'error' THEN 'odd' ELSE 'network' END AS event_type,
      CASE WHEN event_id % 13 > 0 THEN date_trunc('second', ts) END AS ts, CASE WHEN event_id % 17 > 0 THEN 'read' END AS action,
      CASE WHEN event_id % 13 = 0 OR ts IS NULL THEN 'timestamp' WHEN event_id % 17 = 0 THEN 'action' WHEN event_type = 'error' THEN 'unknown event type'
        WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'process without pid' END AS error FROM events)
    """,
)
def reader_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as capture files of one array each; rejected ones come back with their error."""
    i, kind = F.col("event_id"), F.col("event_type")
    data = F.create_map(
        F.lit("action"), F.when(i % 17 > 0, "READ"), F.lit("pid"), F.when((kind == "view") & (i % 3 > 0), i.cast("string")), F.lit("path"), F.lit("/a"), F.lit("ip"), i.cast("string"),
    )
    record = F.struct(
        F.when(kind == "view", "process").when(kind == "click", "FILE").when(kind == "error", "odd").otherwise("Network").alias("event_type"),
        F.when(i % 13 > 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("never").alias("timestamp"), F.lit("s").alias("source_system"), data.alias("event_data"),
    )
    path = _arrays(_t(spark, sf_dir, "events"), F.floor(i / 5000), record, "capture")
    good, bad = readers.capture_events(readers.read_json(spark, path, readers.CAPTURE))
    return good.unionByName(bad, allowMissingColumns=True).select(F.col("dst_ip").cast("long").alias("event_id"), "event_type", "ts", "action", "error")


@register("reader_file_hashes", "SELECT s_suppkey, sha256(s_name || chr(10)) AS sha256, strlen(s_name) + 1 AS size FROM supplier")
def reader_file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as files, hashed."""
    path = _file_each(_t(spark, sf_dir, "supplier"), F.col("s_suppkey"), F.col("s_name"), "files")
    return readers.file_hashes(spark, f"{path}/*/*.txt").select(F.regexp_extract("path", r"k=(\d+)", 1).cast("long").alias("s_suppkey"), "sha256", "size")


@register(
    "reader_pe_metadata",
    """
    SELECT sha256(CAST(s_suppkey AS VARCHAR)) AS sha256, e.event_id, e.event_type, e.action FROM supplier, (VALUES ('drop', 'file', 'write'), ('exec', 'process', 'create'), ('text', 'file', 'modify'), ('0', 'registry', 'modify'), ('2', 'network', 'send')) v(w, event_type, action),
      LATERAL (SELECT CASE w WHEN 'drop' THEN 'sorel_file_' || left(sha256(CAST(s_suppkey AS VARCHAR)), 8) || '_drop' WHEN 'exec' THEN 'sorel_proc_' || left(sha256(CAST(s_suppkey AS VARCHAR)), 8) || '_exec'
        WHEN 'text' THEN 'sorel_sec_' || left(sha256(CAST(s_suppkey AS VARCHAR)), 8) || '_text' ELSE 'sorel_sim_' || left(sha256(CAST(s_suppkey AS VARCHAR)), 8) || '_' || event_type || '_' || w END AS event_id, event_type, action) e
    WHERE w <> '2' OR s_suppkey % 2 = 0
    """,
)
def reader_pe_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as files of program metadata, named by their hash, and the chains that follow from them."""
    symbol = lambda n: F.struct(F.lit("a.dll").alias("DLL"), n.alias("Name"))
    symbols = F.array(F.array(symbol(F.lit("RegSetValueA")), symbol(F.lit("nothing")), symbol(F.when(F.col("s_suppkey") % 2 == 0, "sendto").otherwise("zzz"))))
    section = F.array(F.struct(F.struct(F.lit(".text\\x00").alias("Value")).alias("Name")))
    body = F.to_json(F.struct(section.alias("PE Sections"), symbols.alias("Imported symbols")))
    path = _file_each(_t(spark, sf_dir, "supplier"), F.sha2(F.col("s_suppkey").cast("string"), 256), body, "pe")
    return telemetry_events.metadata_chain(documents.read_pe_metadata(spark, path)).select("sha256", "event_id", "event_type", "action")


@register(
    "reader_knowledge",
    """
    WITH p AS (SELECT *, CASE WHEN vec_id % 7 = 0 THEN 'unknown class' WHEN vec_id % 11 = 0 THEN 'wrong size of vector' WHEN vec_id % 13 = 0 THEN 'no pattern_id' END AS error FROM embeddings)
    SELECT 'Malware' AS threat_class, NULL AS error, count(*) AS n, round(sum(CAST(embedding[1] AS DOUBLE)), 6) AS first FROM p WHERE error IS NULL AND vec_id % 2 = 0
    UNION ALL SELECT 'APT', NULL, count(*), round(sum(CAST(embedding[1] AS DOUBLE)), 6) FROM p WHERE error IS NULL AND vec_id % 2 = 1
    UNION ALL SELECT NULL, error, count(*), NULL FROM p WHERE error IS NOT NULL GROUP BY error
    """,
)
def reader_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as patterns in knowledge documents, some of them bad: two classes and what was refused."""
    i, v = F.col("vec_id"), F.col("embedding").cast("array<double>")
    rows = _t(spark, sf_dir, "embeddings").select(
        F.when((i % 13 == 0) & (i % 7 > 0) & (i % 11 > 0), "").otherwise(i.cast("string")).alias("pattern_id"), F.when(i % 7 == 0, "Odd").when(i % 2 == 0, "Malware").otherwise("APT").alias("threat_class"),
        F.when((i % 11 == 0), F.slice(v, 1, 63)).otherwise(v).alias("embedding"),
    )
    path = _folder(spark, "knowledge")
    documents.write_patterns(rows, path)
    good, bad = documents.read_patterns(spark, path, 64)
    none = F.lit(None).cast("string")
    kinds = [documents.of_class(good, c).agg(F.lit(c).alias("threat_class"), none.alias("error"), F.count("*").alias("n"), F.round(F.sum(F.get("embedding", F.lit(0))), 6).alias("first")) for c in ("Malware", "APT")]
    return kinds[0].unionByName(kinds[1]).unionByName(bad.groupBy("error").agg(none.alias("threat_class"), F.count("*").alias("n"), F.lit(None).cast("double").alias("first")))


@register(
    "dataset_registry",
    """
    WITH d AS (SELECT *, CASE p_size % 3 WHEN 0 THEN 'network_traffic' WHEN 1 THEN 'honeypot_logs' ELSE 'vulnerabilities' END AS kind, CASE p_size % 2 WHEN 0 THEN 'csv' ELSE 'json' END AS format,
        CASE WHEN p_partkey % 4 = 0 THEN 'ingested' ELSE 'available' END AS status, CASE WHEN p_partkey % 4 = 0 THEN p_size END AS c FROM part WHERE p_size % 5 > 0)
    SELECT kind, status, format, count(*) AS n, coalesce(CAST(sum(c) AS BIGINT), 0) AS records, 0.5e0 * count(*) AS size_mb FROM d GROUP BY GROUPING SETS ((kind), (status), (format), ())
    UNION ALL SELECT kind, 'list', status, count(*), min(p_partkey), NULL FROM d WHERE kind = 'honeypot_logs' AND status = 'ingested' GROUP BY ALL
    UNION ALL SELECT NULL, 'refused', 'unknown kind', count(*), NULL, NULL FROM part WHERE p_size % 5 = 0
    """,
)
def dataset_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as data sets: registered, some refused, a quarter updated once read in; totals and one list."""
    k, s = F.col("p_partkey"), F.col("p_size")
    kind = F.when(s % 5 == 0, "other").when(s % 3 == 0, "network_traffic").when(s % 3 == 1, "honeypot_logs").otherwise("vulnerabilities")
    rows = _t(spark, sf_dir, "part").select(
        k.cast("string").alias("dataset_id"), F.col("p_name").alias("name"), kind.alias("kind"), F.when(s % 2 == 0, "csv").otherwise("json").alias("format"), F.lit("available").alias("status"),
        F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("record_count"), F.lit(0.5).alias("size_mb"), s.alias("size"),
    )
    log = _folder(spark, "registry")
    refused = documents.register_datasets(rows.drop("size"), log)
    later = rows.filter(k % 4 == 0).withColumns({"status": F.lit("ingested"), "record_count": F.col("size").cast("long")}).drop("size")
    documents.register_datasets(later, log)
    totals = documents.dataset_statistics(documents.datasets(spark, log))
    listed = documents.datasets(spark, log, "honeypot_logs", "ingested").groupBy("kind", F.lit("list").alias("status"), F.col("status").alias("format"))
    listed = listed.agg(F.count("*").alias("n"), F.min(F.col("dataset_id").cast("long")).alias("records"))
    lost = refused.groupBy(F.col("error").alias("format")).agg(F.count("*").alias("n")).withColumn("status", F.lit("refused"))
    return totals.unionByName(listed, allowMissingColumns=True).unionByName(lost, allowMissingColumns=True)


@register(
    "match_log",
    """
    WITH m AS (SELECT user_id || '/' || event_type AS match_id, event_id, ts FROM events WHERE event_id % 3 < 2)
    SELECT match_id, event_id FROM m QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY event_id % 3 DESC, ts DESC, event_id DESC) = 1
    """,
)
def match_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches stored in two batches under their id, and the log's newest row of each: the second batch wins, then the newer event."""
    path, rows = _folder(spark, "matches"), _t(spark, sf_dir, "events").withColumn("match_id", F.concat_ws("/", "user_id", "event_type"))
    for batch in (0, 1):
        sinks.append(rows.filter(F.col("event_id") % 3 == batch), path, F.timestamp_seconds(F.lit(batch)))
    found = sinks.current(spark, path, ["match_id"], [F.desc("logged_at"), F.desc("ts"), F.desc("event_id")])
    return found.select("match_id", "event_id")
