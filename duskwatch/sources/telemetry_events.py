"""Raw event JSON to nested telemetry events, and PE objects to chains of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions.net import ip_class

_MAP = "map<string,string>"
RAW = (
    "event_type string, category string, event_id string, raw_event_id string, timestamp string, host_id string, source string, provider string, channel string, "
    f"severity string, parent_event_id string, correlation_id string, confidence double, event_data {_MAP}, process {_MAP}, network {_MAP}, dns {_MAP}, "
    f"authentication {_MAP}, auth {_MAP}, file {_MAP}, provenance {_MAP}"
)
# Categories, words that stand for a missing value, and switches whose value is a secret.
CATEGORIES = ("process", "network", "dns", "authentication", "file", "system")
MISSING = ("Not available", "unknown", "None", "-", "")
SECRET_SWITCH = r"(?i)(--password|-password|-token|-secret|-p)\s+[^\s]+"
# Words in names of imported functions, in order, and the event type and action that they stand for.
API_EVENTS = (
    ("copyfile", "file", "write"), ("createfile", "file", "create"), ("writefile", "file", "write"), ("readfile", "file", "read"),
    ("deletefile", "file", "delete"), ("movefile", "file", "rename"), ("setfileattributes", "file", "modify"), ("getfileattributes", "file", "read"),
    ("createprocess", "process", "create"), ("winexec", "process", "create"), ("shellexecute", "process", "create"), ("terminateprocess", "process", "terminate"),
    ("regcreatekey", "registry", "create"), ("regopenkey", "registry", "modify"), ("regsetvalue", "registry", "modify"), ("regdeletekey", "registry", "delete"),
    ("internetopen", "network", "connect"), ("internetconnect", "network", "connect"), ("httpsendrequest", "network", "connect"), ("gethostbyname", "network", "dns"),
    ("socket", "network", "connect"), ("connect", "network", "connect"), ("send", "network", "send"), ("recv", "network", "receive"),
)
# Sections of a program that are run.
RUN_SECTIONS = (".text", "code", "upx0", "upx1")
PE_OBJECT = "sha256 string, label int, size long, imports map<string,array<string>>"
PE_METADATA = (
    "DOS_HEADER map<string,string>, OPTIONAL_HEADER struct<SizeOfImage: struct<Value: long>>, "
    "`PE Sections` array<struct<Name: struct<Value: string>>>, `Imported symbols` array<array<struct<DLL: string, Name: string, Structure: string>>>"
)


def mask_credentials(command: Column) -> Column:
    """A command line with the values of password, token and secret switches replaced."""
    return F.regexp_replace(command, F.lit(SECRET_SWITCH), F.lit("$1 [REDACTED]"))


def parse_raw(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(events, bad lines) of raw JSON texts; unknown keys are ignored."""
    parsed = lines.select(F.col(column).alias("value"), F.from_json(column, RAW).alias("r"), F.try_parse_json(column).isNotNull().alias("ok"))
    return parsed.filter("ok").select("value", "r.*"), parsed.filter("not ok").select("value")


def normalise(raw: DataFrame, mode: str = "LIVE") -> DataFrame:
    """Nested telemetry events of parsed raw ones.

    A part (process, network, dns, authentication, file) is null unless the type asks for it or its keys are there.
    Within a part the first key of a chain that is there wins; text parts fall back on "Not available", ports on 0.
    Nothing is drawn at random: an event without an id gets a hash of its content, one without a time a null one.
    """
    kind = F.lower(F.coalesce("event_type", F.lit("process")))
    held = lambda key: F.coalesce(F.map_contains_key("event_data", key), F.lit(False))

    def get(part: str, *keys: str, default: str | None = "Not available") -> Column:
        source = F.coalesce(F.col("event_data"), F.col(part))
        return F.coalesce(*[F.try_element_at(source, F.lit(k)) for k in keys], F.lit(default))

    def when(cond: Column, **fields: Column) -> Column:
        return F.when(cond, F.struct(*[v.alias(k) for k, v in fields.items()]))

    number = lambda c: c.try_cast("double").cast("long")
    parts = {
        "process": when(
            kind.isin("process", "powershell") | F.col("process").isNotNull() | held("pid"),
            pid=number(get("process", "pid", "Id", default=None)), ppid=number(get("process", "ppid", "parent_pid", default=None)),
            name=get("process", "name", "ProcessName", "image", default="unknown"), path=get("process", "path", "Path", "exe"),
            command_line=mask_credentials(get("process", "command_line", "command", "cmdline")), user=get("process", "user", "username"),
        ),
        "network": when(
            (kind == "network") | F.col("network").isNotNull() | held("src_ip"),
            src_ip=get("network", "src_ip", "source_ip"), src_port=number(get("network", "src_port", "source_port", default="0")),
            dst_ip=get("network", "dst_ip", "dest_ip"), dst_port=number(get("network", "dst_port", "dest_port", default="0")),
            protocol=F.upper(get("network", "protocol", default="TCP")), state=F.upper(get("network", "state", default="ESTABLISHED")),
        ),
        "dns": when(
            (kind == "dns") | F.col("dns").isNotNull(),
            query=get("dns", "query", "query_name"), record_type=get("dns", "record_type", "type", default="A"), response=get("dns", "response", "result"),
        ),
        "authentication": when(
            (kind == "authentication") | F.col("auth").isNotNull() | F.contains(F.lower("value"), F.lit("logon")),
            user=get("authentication", "user", "username"), logon_type=get("authentication", "logon_type", "logon_kind", default="Interactive"),
            source_ip=get("authentication", "source_ip", "src_ip"), result=F.upper(get("authentication", "result", "status", default="SUCCESS")),
        ),
        "file": when(
            (kind == "file") | F.col("file").isNotNull(),
            path=get("file", "path", "file_name"), operation=get("file", "operation", "action", default="write"), hash=get("file", "hash", "sha256"),
        ),
    }
    own_id = F.coalesce("event_id", F.concat(F.lit("evt-"), F.substring(F.sha2("value", 256), 1, 32)))
    return raw.select(
        own_id.alias("event_id"), "timestamp", "host_id", F.coalesce("source", F.lit("windows")).alias("source"), F.lit(mode).alias("source_mode"), kind.alias("event_type"),
        F.coalesce("category", F.when(kind.isin(*CATEGORIES[:-1]), kind).otherwise(F.lit("system"))).alias("category"), F.lower(F.coalesce("severity", F.lit("info"))).alias("severity"),
        *[v.alias(k) for k, v in parts.items()],
        F.struct(F.coalesce("provider", "source", F.lit("windows")).alias("provider"), F.coalesce("raw_event_id", "event_id", own_id).alias("event_id"),
                 F.coalesce("channel", F.lit("Security")).alias("channel")).alias("raw_source"),
        "provenance", "parent_event_id", "correlation_id", F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    )


def with_provenance(events: DataFrame) -> DataFrame:
    """Events whose provenance is there: one that is missing says source, collector, time and confidence of the event itself."""
    origin = F.when(F.contains(F.lower("source"), F.lit("tpot")), F.lit("TPOT")).when(F.col("source_mode") == "LIVE", F.lit("LIVE_HOST")).otherwise(F.lit("SCENARIO_REPLAY"))
    own = {
        "source_type": origin, "source_id": F.col("host_id"), "collector": F.concat_ws("_", "source", "event_type"), "event_id": F.col("event_id"), "observed_at": F.col("timestamp"),
        "processing_stage": F.lit("normalized"), "confidence_calibrated": F.col("confidence").cast("string"), "calibration_method": F.lit("Platt_CCF_Task6_1"), "evidence_count": F.lit("1"),
    }
    made = F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)])
    return events.withColumn("provenance", F.when(F.size(F.coalesce("provenance", F.create_map().cast(_MAP))) > 0, F.col("provenance")).otherwise(made))


def flat(events: DataFrame) -> DataFrame:
    """Twelve often-used values at the top level; words for "missing" and ports 0 become null."""
    clean = lambda c: F.when(~F.trim(c).isin(*MISSING), F.trim(c))
    port = lambda c: F.when(F.col(c) != 0, F.col(c))
    command = clean(F.col("process.command_line"))
    top = {
        "pid": F.col("process.pid"), "parent_pid": F.col("process.ppid"), "user": F.coalesce(clean(F.col("process.user")), clean(F.col("authentication.user"))),
        "src_ip": F.coalesce(clean(F.col("network.src_ip")), clean(F.col("authentication.source_ip"))), "src_port": port("network.src_port"),
        "dst_ip": clean(F.col("network.dst_ip")), "dst_port": port("network.dst_port"), "protocol": clean(F.col("network.protocol")), "command": command,
        "payload": F.coalesce(command, clean(F.col("file.path")), clean(F.col("dns.query"))), "raw_event_id": clean(F.col("raw_source.event_id")),
        "ip_classification": ip_class(clean(F.col("network.dst_ip"))),
    }
    return events.withColumns(top)


def event_error(events: DataFrame) -> Column:
    """Why a normalised event is refused: mode, category or a port out of range; null if it is valid."""
    bad_port = lambda c: ~F.coalesce(F.col(c).between(0, 65535), F.lit(True))
    return (
        F.when(~F.col("source_mode").isin("LIVE", "SCENARIO"), F.lit("source_mode"))
        .when(~F.col("category").isin(*CATEGORIES), F.lit("category"))
        .when(bad_port("network.src_port") | bad_port("network.dst_port"), F.lit("port"))
    )


def api_event(name: Column) -> Column:
    """Event type and action of an imported function by the first word in its name; null if it has none."""
    out = F.lit(None).cast("struct<event_type: string, action: string>")
    for word, kind, action in reversed(API_EVENTS):
        out = F.when(F.contains(F.lower(name), F.lit(word)), F.struct(F.lit(kind).alias("event_type"), F.lit(action).alias("action"))).otherwise(out)
    return out


def pe_file_events(objects: DataFrame) -> DataFrame:
    """One file event for each PE object: path by its hash, label, imported libraries; objects without a hash are left out."""
    return objects.filter("sha256 <> ''").select(
        F.concat(F.lit("ember_sim_"), F.left("sha256", F.lit(8)), F.lit("_file")).alias("event_id"), F.lit("file").alias("event_type"), F.lit("write").alias("action"),
        F.concat(F.lit("C:\\Windows\\Temp\\"), F.left("sha256", F.lit(16)), F.lit(".exe")).alias("path"), F.coalesce("size", F.lit(102400)).alias("file_size"),
        F.col("sha256").alias("hash"), F.when(F.col("label") == 1, F.lit("malware")).otherwise(F.lit("benign")).alias("label"), F.map_keys("imports").alias("api_imports"),
    )


def chain(objects: DataFrame, key: str, functions: Column, path: Column, prefix: str, sections: Column | None = None) -> DataFrame:
    """Events of each object in order: its file appears, it runs, its sections are mapped, and each imported function with a known word acts.

    One row per event: key, seq, event_id, event_type, action, target, api. Functions without a known word give no event.
    """
    short = F.left(F.col(key), F.lit(8))
    text = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    event = lambda rank, at, event_id, kind, action, target, api: F.struct(
        F.lit(rank).alias("rank"), at.cast("int").alias("at"), event_id.alias("event_id"), kind.alias("event_type"), action.alias("action"), target.alias("target"), api.alias("api")
    )
    none = F.lit(None).cast("string")
    first = F.array(
        event(0, F.lit(0), text(f"{prefix}_file_", short, "_drop"), F.lit("file"), F.lit("write"), path, none),
        event(1, F.lit(0), text(f"{prefix}_proc_", short, "_exec"), F.lit("process"), F.lit("create"), path, none),
    )
    held = F.filter(F.coalesce(sections, F.array().cast("array<string>")) if sections is not None else F.array().cast("array<string>"), lambda s: F.lower(s).isin(*RUN_SECTIONS))
    mapped = F.transform(held, lambda s, i: event(2, i, text(f"{prefix}_sec_", short, "_", F.replace(s, F.lit("."), F.lit(""))), F.lit("file"), F.lit("modify"), text(path, ":", s), none))
    acts = F.transform(functions, lambda f, i: F.struct(f.alias("api"), i.alias("i"), api_event(f).alias("e")))
    acts = F.transform(
        F.filter(acts, lambda a: a["e"].isNotNull()),
        lambda a: event(3, a["i"], text(f"{prefix}_sim_", short, "_", a["e"]["event_type"], "_", a["i"].cast("string")), a["e"]["event_type"], a["e"]["action"], none, a["api"]),
    )
    rows = objects.select(key, F.posexplode(F.concat(first, mapped, acts)).alias("seq", "e"))
    return rows.select(key, "seq", "e.event_id", "e.event_type", "e.action", "e.target", "e.api")


def metadata_chain(objects: DataFrame, key: str = "sha256") -> DataFrame:
    """The chain of PE metadata with nested tables of sections and imported symbols, see ``PE_METADATA``."""
    symbols = F.filter(F.flatten("Imported symbols"), lambda s: s["Name"].isNotNull() & s["Structure"].isNull())
    names = F.transform(symbols, lambda s: s["Name"])
    sections = F.transform(F.col("PE Sections"), lambda s: F.trim(F.replace(s["Name"]["Value"], F.lit("\\x00"), F.lit(""))))
    path = F.concat(F.lit("C:\\Windows\\System32\\"), F.left(key, F.lit(16)), F.lit(".exe"))
    return chain(objects, key, F.coalesce(names, F.array().cast("array<string>")), path, "sorel", sections)
