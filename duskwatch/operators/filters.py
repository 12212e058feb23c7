"""Filters and searches. Arguments that are None add no condition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Time ranges by name; anything else counts as 24 hours, "all" as no filter.
RANGES = {"15m": "15 minutes", "1h": "1 hour", "6h": "6 hours", "24h": "24 hours", "7d": "7 days"}
# Command-line rules in order; the first that matches wins.
COMMAND_RULES = (
    ("encoded_powershell", r"(?i)powershell.*-enc(odedcommand)?\s+[A-Za-z0-9+/=]{20,}"),
    ("certutil_decode", r"(?i)certutil.*-decode"),
    ("bitsadmin_transfer", r"(?i)bitsadmin.*/transfer"),
    ("shadow_deletion", r"(?i)vssadmin.*delete\s+shadows"),
)
# Actions that a capture event of each type may have.
ACTIONS = {
    "process": ["create", "terminate", "parent_child"],
    "file": ["read", "write", "delete", "encrypt", "rename"],
    "network": ["dns", "http", "https", "smb", "c2", "beaconing", "upload", "download"],
    "auth": ["login", "logout", "escalate", "token_abuse"],
    "registry": ["modify", "create", "delete", "service_create", "scheduled_task"],
    "user": ["mouse", "keyboard", "usb", "session"],
}


def both(*conds: Column | None) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conds if c is not None], F.lit(True))


def in_time_range(ts: Column, as_of: Column, name: str) -> Column:
    """Rows no older than the range; rows without a timestamp are kept."""
    if name == "all":
        return F.lit(True)
    return ts.isNull() | (ts >= as_of - F.expr(f"INTERVAL {RANGES.get(name, RANGES['24h'])}"))


def search(df: DataFrame, equal: dict[str, str | None], text: str | None = None, text_cols: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose columns equal the values case-insensitively and whose text holds ``text`` in one of the columns."""
    conds = [F.upper(F.col(c)) == v.upper() for c, v in equal.items() if v]
    if text:
        conds.append(reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(text.lower()) for c in text_cols]))
    return df.filter(both(*conds))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a totally ordered result."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))


def allowed_action(kind: Column, action: Column) -> Column:
    """True if the action, as written, is on the list of its event type; false for unknown types and null."""
    table = F.create_map(*[x for k, v in ACTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.array_contains(F.try_element_at(table, kind), action), F.lit(False))


def validity_error(required: dict[str, Column]) -> Column:
    """Name of the first missing field, null if the row is valid."""
    missing = [F.when(c.isNull() | (c.cast("string") == ""), F.lit(n)) for n, c in required.items()]
    return F.coalesce(*missing) if missing else F.lit(None).cast("string")


def good_and_bad(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their error."""
    marked = df.withColumn("error", error)
    return marked.filter("error is null").drop("error"), marked.filter("error is not null")


def command_rule(command: Column) -> Column:
    """Name of the first command-line rule that matches, else null."""
    out = F.when(command.rlike(COMMAND_RULES[0][1]), F.lit(COMMAND_RULES[0][0]))
    for name, pattern in COMMAND_RULES[1:]:
        out = out.when(command.rlike(pattern), F.lit(name))
    return out
