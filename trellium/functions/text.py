"""Scalar functions on text: redaction, hashes, validation, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Loopback, private and link-local hosts; of IPv6 ::1, fc00::/7 and fe80::/10.
LOCAL = (
    r"(?i)^(localhost|127\.\d+\.\d+\.\d+|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+|169\.254\.\d+\.\d+"
    r"|\[::1\]|\[f[cd][0-9a-f]{2}:[0-9a-f:.]*\]|\[fe[89ab][0-9a-f]:[0-9a-f:.]*(%[^\]]*)?\])$"
)


def redact_endpoint(url: Column) -> Column:
    """Scheme, host, port and path of a local endpoint; the host of any other is hidden. Idempotent."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    authority = F.regexp_extract(url, r"://([^/?#]*)", 1)
    bare = F.regexp_replace(authority, r"^.*@", "")
    host, port = F.regexp_replace(bare, r":\d+$", ""), F.regexp_extract(bare, r"(:\d+)$", 1)
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    kept = F.when(host.rlike(LOCAL), F.concat(host, port)).otherwise("redacted")
    return F.when(scheme == "", "redacted").otherwise(F.concat(scheme, F.lit("://"), kept, path))


def is_commit(text: Column) -> Column:
    return text.rlike(r"\A[0-9a-fA-F]{40}\z")


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def checked_sha256(value: Column, digest: Column) -> Column:
    """The hexadecimal digest of the value, failing where it is not the one expected."""
    found = sha256(value)
    return F.when(found == F.lower(digest), found).otherwise(F.raise_error(F.concat(F.lit("digest is "), F.coalesce(found, F.lit("null")))))


def is_user_turn(role: Column, content: Column) -> Column:
    """A turn of the user that is no wrapped tool result."""
    return (role == "user") & ~F.coalesce(F.regexp_replace(content, r"^\s+", "").startswith("<tool_response>"), F.lit(False))


def malformed_key(reason: Column) -> Column:
    """The histogram key of a parse error: its last part, 120 characters at most."""
    return F.substring(F.trim(F.substring_index(reason, ":", -1)), 1, 120)


def isclose(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return F.abs(a - b) <= tolerance


def json_field(text: Column, path: str, kind: str) -> Column:
    """struct<value, fault>: the field at ``$.path`` as integer, number, string or object, else why not, naming the path.

    Booleans are no numbers; a number without a fraction is an integer too.
    """
    field = F.try_variant_get(F.try_parse_json(text), f"$.{path}", "variant")
    found = F.schema_of_variant(field)
    number = F.try_variant_get(F.try_parse_json(text), f"$.{path}", "double")
    numeric = found.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    fits, value = {
        "integer": (numeric & (number == F.floor(number)), F.floor(number).cast("string")),
        "number": (numeric, number.cast("string")),
        "string": (found == "STRING", F.try_variant_get(F.try_parse_json(text), f"$.{path}", "string")),
        "object": (found.startswith("OBJECT"), F.to_json(field)),
    }[kind]
    ok = F.coalesce(fits, F.lit(False))
    return F.struct(F.when(ok, value).alias("value"), F.when(~ok, F.lit(f"{path}: no {kind}")).alias("fault"))


def python_json(compact: Column) -> Column:
    """JSON text without spaces as Python's ``json.dumps`` lays it out: one after each comma and colon outside strings."""
    parts = F.regexp_extract_all(compact, F.lit(r'"(?:[^"\\]|\\.)*"|[^"]'), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.isin(",", ":"), F.concat(x, F.lit(" "))).otherwise(x)), "")
