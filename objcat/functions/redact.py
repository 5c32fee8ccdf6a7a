"""Redaction of text before it is written down: control characters, URL secrets, credentials in an address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from objcat.schema import as_col

REDACTED = "<redacted>"

# A query key holding one of these words carries a secret.
SENSITIVE_WORDS = [
    "authorization",
    "x-bz-file-info-src_last_modified_millis",
    "password",
    "passphrase",
    "secret",
    "token",
    "access_key",
    "secret_key",
    "app_key",
    "api_key",
    "apikey",
    "credential",
    "signature",
    "x-amz-security-token",
    "set-cookie",
    "cookie",
]


def escape_controls(col: Column | str) -> Column:
    """Every control character as a `\\uXXXX` escape; clean text passes unchanged."""
    col = as_col(col)
    pieces = F.regexp_extract_all(col, F.lit(r"\p{Cc}|[^\p{Cc}]+"), F.lit(0))
    escaped = F.transform(
        pieces,
        lambda p: F.when(
            p.rlike(r"\A\p{Cc}"), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(p))), 4, "0"))
        ).otherwise(p),
    )
    return F.when(col.rlike(r"\p{Cc}"), F.array_join(escaped, "")).otherwise(col)


def redact_url(col: Column | str) -> Column:
    """Query values under a sensitive key are replaced; the rest of the URL survives."""
    col = as_col(col)
    words = "(?i)" + "|".join(w.replace("-", r"\-") for w in SENSITIVE_WORDS)
    base = F.substring_index(col, "?", 1)
    query = F.substring(col, F.char_length(base) + 2, F.char_length(col))
    pairs = F.transform(
        F.split(query, "&"),
        lambda p: F.when(
            p.contains("=") & F.substring_index(p, "=", 1).rlike(words),
            F.concat(F.substring_index(p, "=", 1), F.lit("=" + REDACTED)),
        ).otherwise(p),
    )
    return F.when(col.contains("?"), F.concat(base, F.lit("?"), F.array_join(pairs, "&"))).otherwise(col)


def fingerprint(col: Column | str) -> Column:
    """A short digest that tells two secrets apart without showing either."""
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(as_col(col), 256), 1, 8))


def redact_remote(col: Column | str) -> Column:
    """`scheme://user:pw@host…`: the credentials become a fingerprint, then URL and control rules apply."""
    col = as_col(col)
    shape = r"(?s)\A(.*?)://([^/?#]*)@([^/?#@]*)([/?#].*)?\z"
    bare = F.when(
        col.rlike(shape),
        F.concat(
            F.regexp_extract(col, shape, 1),
            F.lit("://"),
            fingerprint(F.regexp_extract(col, shape, 2)),
            F.lit("@"),
            F.regexp_extract(col, shape, 3),
            F.regexp_extract(col, shape, 4),
        ),
    ).otherwise(col)
    return escape_controls(redact_url(bare))
