"""Text, JSON, time and hash expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

# Redaction rules in the order in which they apply. RE2 and Java read them alike.
REDACTIONS = (
    ("bearer_token", r"(?i)Bearer\s+[A-Za-z0-9_\-\.]{15,}", "Bearer [REDACTED_TOKEN]"),
    ("api_key_openai", r"(?i)sk-proj-[A-Za-z0-9_-]{20,}", "[API_KEY_OPENAI_REDACTED]"),
    ("api_key_aws", r"(?i)AKIA[0-9A-Z]{16}", "[API_KEY_AWS_REDACTED]"),
    ("generic_secret_key", r"(?i)(api[_-]?key|secret|token|auth_header)\s*[:=]\s*['\"]?[A-Za-z0-9_\-\.]{12,}['\"]?", "[GENERIC_SECRET_KEY_REDACTED]"),
    ("cli_password_param", r"(?i)(--password[= ]|-pass[= ]|password[= ]|pass[= ]|-p\s*['\"]?)([^\s'\"]{3,})", "$1 [REDACTED_PASSWORD]"),
    ("net_use_password", r"(?i)net\s+use.*?\s+([^\s]{3,})$", "[NET_USE_PASSWORD_REDACTED]"),
    ("credit_card", r"\b(?:\d[ -]*?){13,16}\b", "[REDACTED_CC]"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    ("email_address", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[REDACTED_EMAIL]"),
)
# The folder prefix stays, the user's name goes; counted as no rule.
HOME = (r"(?i)(C:\\Users\\|/home/|/Users/)([^\\/]+)", "$1[REDACTED_USER]")

TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss.SSSSSS", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm")


def nonempty(*cols: Column) -> Column:
    """First column that is neither null nor an empty string."""
    return F.coalesce(*[F.when(c.cast("string") != "", c.cast("string")) for c in cols])


def has(col: Column, *words: str) -> Column:
    """True if the lower-cased text holds one of the words as a substring; false for null."""
    text = F.lower(F.coalesce(col, F.lit("")))
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def has_token(col: Column, words: list[str]) -> Column:
    """True if one of the words stands alone between white space, dashes and slashes."""
    tokens = F.split(F.translate(F.lower(F.coalesce(col, F.lit(""))), "-/\\", "   "), r"\s+")
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def redact(col: Column) -> Column:
    """Text with secrets and personal data replaced, rule by rule, and user names in home folders; null stays null."""
    return reduce(lambda text, rule: F.regexp_replace(text, F.lit(rule[-2]), F.lit(rule[-1])), (*REDACTIONS, HOME), col)


def redact_nested(col: Column, kind: DataType) -> Column:
    """Every string in structs, arrays and map values redacted; other values and all names stay."""
    if isinstance(kind, StringType):
        return redact(col)
    if isinstance(kind, StructType):
        fields = [redact_nested(col[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(col, lambda x: redact_nested(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(col, lambda _, x: redact_nested(x, kind.valueType))
    return col


def redaction_hits(col: Column) -> Column:
    """Names of the rules that replace something, each judged on the output of those before it."""
    hits, text = [], F.coalesce(col, F.lit(""))
    for name, pattern, put in REDACTIONS:
        hits.append(F.when(text.rlike(pattern), F.lit(name)))
        text = F.regexp_replace(text, pattern, F.lit(put))
    return F.array_compact(F.array(*hits))


def entropy(col: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for null and empty."""
    chars = F.split(F.coalesce(col, F.lit("")), "")
    n = F.size(chars).cast("double")
    parts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    bits = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(F.char_length(F.coalesce(col, F.lit(""))) == 0, F.lit(0.0)).otherwise(bits)


def event_fingerprint(*cols: Column) -> Column:
    """SHA-256 over the parts joined by colons; null counts as an empty part."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def pattern_fingerprint(version: str, *cols: Column) -> Column:
    """First 16 hex digits in upper case of the SHA-256 over a version and named parts."""
    text = F.concat_ws("|", F.lit(version), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.upper(F.substring(F.sha2(text, 256), 1, 16))


def parse_time(col: Column) -> Column:
    """Timestamp from ISO text, one of the known formats, or epoch seconds; null if none fits."""
    text = F.trim(col)
    formats = [F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS]
    epoch = F.when(text.rlike(r"^\d{9,11}(\.\d+)?$"), F.timestamp_micros((text.try_cast("double") * 1e6).cast("long")))
    millis = F.when(text.rlike(r"^\d{12,14}$"), F.timestamp_millis(text.try_cast("long")))
    return F.coalesce(millis, epoch, F.try_to_timestamp(text), *formats)


def number(col: Column) -> Column:
    """Lenient number: 0 where the text isn't one."""
    return F.coalesce(F.trim(col.cast("string")).try_cast("double"), F.lit(0.0))


def json_list(col: Column) -> Column:
    """JSON array of strings; a scalar becomes a list of one, null and empty an empty list."""
    parsed = F.from_json(col, "array<string>")
    single = F.when(F.coalesce(F.trim(col), F.lit("")) != "", F.array(F.trim(col, F.lit('"'))))
    listed = F.startswith(F.ltrim(F.coalesce(col, F.lit(""))), F.lit("["))
    return F.coalesce(F.when(listed, parsed), single, F.array().cast("array<string>"))


def typed_setting(value: Column, kind: Column) -> Column:
    """A setting as struct (s, i, d, b): only the field of its kind is set, null where it doesn't parse."""
    truth = F.lower(F.trim(value)).isin("true", "1", "yes")
    return F.struct(
        F.when(kind.isin("string", "json"), value).alias("s"),
        F.when(kind == "int", value.try_cast("long")).alias("i"),
        F.when(kind == "float", value.try_cast("double")).alias("d"),
        F.when(kind == "bool", truth).alias("b"),
    )


def summary(fields: dict[str, Column], most: int = 3) -> Column:
    """First ``most`` non-null fields as ``name=value`` joined by commas."""
    parts = F.array_compact(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{n}="), c.cast("string"))) for n, c in fields.items()]))
    return F.array_join(F.slice(parts, 1, most), ", ")
