"""Column functions on text: redaction, truncation, chunks, identifiers and hashes."""

from __future__ import annotations

import hashlib
import json
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The redaction rules of texts, in their order; matching ignores case.
TEXT_RULES = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"),
    ("phone", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "[PHONE_REDACTED]"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[SSN_REDACTED]"),
    ("credit_card", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "[CC_REDACTED]"),
    ("secret_marker", r"""(password|api[_-]?key|secret|token)["\s:=]+[A-Za-z0-9+/=]{8,}""", "[SECRET_REDACTED]"),
)
# Header names and URL parameters that hold secrets, and patterns of secrets in payloads.
SECRET_HEADERS = ("authorization", "cookie", "set-cookie", "x-api-key", "api-key", "x-auth-token", "bearer", "x-access-token", "x-secret", "x-csrf-token")
SECRET_PARAMETERS = ("api_key", "apikey", "key", "token", "secret", "password", "passwd", "pwd", "auth", "bearer", "access_token", "refresh_token")
SECRET_PATTERNS = (
    r"""["']?(?:api[_-]?key|apikey)["']?\s*[:=]\s*["']?([a-zA-Z0-9_-]{16,})["']?""",
    r"""["']?bearer\s+([a-zA-Z0-9_.-]+)["']?""",
    r"eyJ[a-zA-Z0-9_-]+\.eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+",
    r"(?:AKIA|ABIA|ACCA|ASIA)[A-Z0-9]{16}",
    r"""["']?(?:secret|password|passwd|pwd)["']?\s*[:=]\s*["']?([^\s"']{8,})["']?""",
)
REDACTED = "[REDACTED]"


def redact(text: Column, rules=TEXT_RULES) -> Column:
    """The text after all rules, each applied to what the one before left."""
    for _, pattern, marker in rules:
        text = F.regexp_replace(text, f"(?i){pattern}", marker)
    return text


def redaction_counts(text: Column, rules=TEXT_RULES) -> dict[str, Column]:
    """For each rule, the matches it replaces."""
    out = {}
    for name, pattern, marker in rules:
        out[name] = F.regexp_count(text, F.lit(f"(?i){pattern}"))
        text = F.regexp_replace(text, f"(?i){pattern}", marker)
    return out


def _offset_step(rule: str):
    def step(so_far: Column, pair: Column) -> Column:
        begin = so_far["at"] + F.length(pair["rest"])
        end = begin + F.length(pair["found"])
        return F.struct(end.alias("at"), F.array_append(so_far["seen"], F.struct(F.lit(rule).alias("rule"), begin.alias("start"), end.alias("end"))).alias("seen"))

    return step


def redaction_offsets(text: Column, rules=TEXT_RULES) -> Column:
    """array<struct<rule, start, end>>: where each rule, in the text that the one before left, finds a match.

    Offsets count characters from 0. They are sums of the lengths of the matches and of what is between them.
    """
    out = F.array().cast("array<struct<rule: string, start: int, end: int>>")
    for name, pattern, marker in rules:
        found, rest = F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(0)), F.split(text, f"(?i){pattern}", -1)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<rule: string, start: int, end: int>>").alias("seen"))

        pairs = F.arrays_zip(found.alias("found"), F.slice(rest, F.lit(1), F.size(found)).alias("rest"))
        out = F.concat(out, F.aggregate(pairs, start, _offset_step(name), lambda x: x["seen"]))
        text = F.regexp_replace(text, f"(?i){pattern}", marker)
    return out


def redact_url(url: Column) -> Column:
    """The values of secret parameters of a URL, replaced."""
    return F.regexp_replace(url, rf"(?i)([?&])({'|'.join(SECRET_PARAMETERS)})=([^&\s]+)", f"$1$2={REDACTED}")


def redact_headers(headers: Column) -> Column:
    """A map of headers, with the values of secret ones replaced."""
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*SECRET_HEADERS), F.lit(REDACTED)).otherwise(v))


def redact_payload(payload: Column) -> Column:
    for pattern in SECRET_PATTERNS:
        payload = F.regexp_replace(payload, f"(?i){pattern}", REDACTED)
    return payload


def truncate_bytes(text: Column, limit: int | Column) -> Column:
    """The first limit bytes of the UTF-8 text; where that cuts a character, three more bytes go first.

    Whole characters are found on the text's hexadecimal digits: continuation bytes begin with 8 to B.
    """
    cut = limit if isinstance(limit, Column) else F.lit(limit)
    data = F.encode(text, "UTF-8")
    boundary = F.octet_length(data) <= cut

    def starts(n: Column) -> Column:
        """Whether a character starts at byte n (from 0), or the text ends there."""
        digit = F.substring(F.hex(F.substring(data, n + 1, F.lit(1))), 1, 1)
        return ~F.coalesce(digit.isin("8", "9", "A", "B"), F.lit(False))

    back = F.greatest(cut - 3, F.lit(0))
    whole = F.when(starts(cut), cut)
    for k in range(4):
        whole = F.coalesce(whole, F.when((back - k <= 0) | starts(back - k), F.greatest(back - k, F.lit(0))))
    return F.when(boundary, text).otherwise(F.decode(F.substring(data, F.lit(1), whole), "UTF-8"))


def chunks(df: DataFrame, text: str, size: int = 2000, overlap: int = 200, most: int | None = 100) -> DataFrame:
    """One row for each chunk of a text: chunk_index, start_offset, end_offset, content, after df's columns.

    Chunks start at multiples of size - overlap. One that doesn't reach the text's end backs off to its last
    space if that is beyond its middle, so text between chunks may be left out. Empty texts have none.
    """
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("size must be positive, and overlap at least 0 and below size")
    step, n = size - overlap, F.length(text)
    count = F.when(n <= size, F.lit(1)).otherwise(1 + F.ceil((n - size) / step).cast("int"))
    count = F.least(count, F.lit(most)) if most is not None else count
    rows = df.where(n > 0).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), count - 1)))
    start = F.col("chunk_index") * step
    whole = F.substring(F.col(text), start + 1, F.lit(size))
    inner = start + size < n
    last = F.length(whole) - F.locate(" ", F.reverse(whole))
    back = inner & (F.instr(whole, " ") > 0) & (last > size // 2)
    end = F.when(back, start + last).otherwise(F.least(start + size, n))
    return rows.withColumns({"start_offset": start, "end_offset": end}).withColumn("content", F.substring(F.col(text), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset")))


def chunk_id(source: Column, index: Column, start: Column, end: Column, version: str = "1.0") -> Column:
    return F.sha2(F.concat_ws(":", source, index.cast("string"), start.cast("string"), end.cast("string"), F.lit(version)), 256)


def evidence_id(kind: Column, source: Column, index: Column) -> Column:
    """The identifier of an item of evidence: a prefix for its kind, twelve digits of its source's hash, its index."""
    prefix, at = F.left(F.sha2(source, 256), F.lit(12)), index.cast("string")
    return (
        F.when(kind == "inline_text", F.concat(F.lit("inline:"), at))
        .when(kind.isin("lake_text", "lake_http"), F.concat_ws(":", F.lit("lake"), prefix, at))
        .when(kind == "sql_result", F.concat_ws(":", F.lit("sql"), prefix, at))
        .when(kind.isin("doc_chunk", "transcript_chunk"), F.concat_ws(":", F.lit("doc"), prefix, at))
        .when(kind == "sql_query_def", F.concat_ws(":", F.lit("sqldef"), prefix))
        .otherwise(F.concat_ws(":", kind, prefix, at))
    )


def safe_name(name: Column) -> Column:
    """A name that can stand in a path: / \\ : become _, at most 100 characters."""
    return F.left(F.translate(name, "/\\:", "___"), F.lit(100))


def dedupe_key(system: Column, name: Column, kind: Column, key: Column) -> Column:
    return F.concat_ws(":", system, name, kind, key)


def row_hash(df: DataFrame, leave_out: tuple[str, ...] = ()) -> Column:
    """SHA-256 (hexadecimal) of a row: name=value by name, nulls as NULL, booleans as 1 and 0."""
    parts = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        if f.name not in leave_out:
            value = F.col(f.name).cast("int").cast("string") if f.dataType.simpleString() == "boolean" else F.col(f.name).cast("string")
            parts.append(F.concat(F.lit(f"{f.name}="), F.coalesce(value, F.lit("NULL"))))
    return F.sha2(F.concat_ws("|", *parts), 256)


def _normal(x):
    if isinstance(x, str):
        return unicodedata.normalize("NFC", x)
    if isinstance(x, float):
        if x != x or x in (float("inf"), float("-inf")):
            return {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}[str(x)]
        return float(f"{x:.15g}") if x else 0.0
    if isinstance(x, dict):
        return {_normal(k): _normal(v) for k, v in x.items()}
    return [_normal(v) for v in x] if isinstance(x, list) else x


def canonical(text: str | None) -> str | None:
    """JSON text in canonical form: sorted keys, NFC, no white space, 15 significant digits; null if it isn't JSON."""
    if text is None:
        return None
    try:
        return json.dumps(_normal(json.loads(text)), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    return text.map(canonical, na_action="ignore")


def content_hash(kind: Column, system: Column, entity: Column, key: Column, request: Column, response: Column) -> Column:
    """The hash of what a record says; not of when it was seen."""
    whole = F.to_json(
        F.struct(kind.alias("exchange_type"), system.alias("source_system"), entity.alias("entity_type"), key.alias("natural_key"), F.lit(1).alias("_")), {"ignoreNullFields": "false"}
    )
    body = F.concat(F.regexp_replace(whole, r',"_":1}$', ""), F.lit(',"request":'), F.coalesce(request, F.lit("null")), F.lit(',"response":'), F.coalesce(response, F.lit("null")), F.lit("}"))
    return F.sha2(canonical_json(body), 256)


def _quoted(value: Column) -> Column:
    """A text as a JSON string: quotes, backslashes and control characters escaped, all else as it is."""
    out = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    clean = out
    for c in range(32):
        clean = F.replace(clean, F.lit(chr(c)), F.lit(short.get(c, f"\\u{c:04x}")))
    return F.concat(F.lit('"'), F.when(F.regexp_like(value, F.lit("[\\x00-\\x1f]")), clean).otherwise(out), F.lit('"'))


def natural_uuid(namespace: str, *key: Column) -> Column:
    """UUIDv5 of a natural key's values in a namespace (schema.table); a null value reads as None.

    The first sixteen bytes of a SHA-1, with the version and the variant in their places.
    """
    base = uuid.uuid5(uuid.NAMESPACE_DNS, namespace).hex
    parts = [_quoted(F.coalesce(k.cast("string"), F.lit("None"))) for k in key]
    name = F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))
    digits = F.sha1(F.concat(F.unhex(F.lit(base)), F.encode(name, "UTF-8")))
    cut = lambda at, n: F.substring(digits, at, n)
    variant = F.translate(cut(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("5"), cut(14, 3)), F.concat(variant, cut(18, 3)), cut(21, 12))


@F.pandas_udf(T.StringType())
def vector_hash(vector: pd.Series) -> pd.Series:
    """SHA-256 of a vector's JSON, rounded to ten digits."""
    return vector.map(lambda v: hashlib.sha256(json.dumps([round(float(x), 10) for x in v]).encode()).hexdigest(), na_action="ignore")
