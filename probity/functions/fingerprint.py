"""Fingerprints of rows and of whole sets: SHA-256 of compact JSON with sorted keys."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CASE_FIELDS = ("case_id", "notes", "text", "variant_id", "variant_type")


def canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def stable_hash(value: object) -> str:
    """The same content gives the same digest; a bare string is hashed with its JSON quotes."""
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def json_text(text: Column) -> Column:
    """A text as a JSON string with its quotes, escaped as ``canonical`` does.

    Spark writes the same, but for the hexadecimal digits of the control characters that have no short escape; only texts that hold
    one of these take the long way.
    """
    short = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
    slow = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        slow = F.replace(slow, F.lit(chr(code)), F.lit("\\" + short[code] if code in short else f"\\u{code:04x}"))
    framed = F.to_json(F.struct(text.alias("t")))
    fast = F.substr(framed, F.lit(6), F.length(framed) - 6)
    return F.when(text.rlike(r"[\x00-\x07\x0B\x0E-\x1F]"), F.concat(F.lit('"'), slow, F.lit('"'))).otherwise(fast)


def text_hash(text: Column) -> Column:
    """``stable_hash`` of a text; null stays null."""
    return F.when(text.isNotNull(), F.sha2(json_text(text).cast("binary"), 256))


def row_fingerprint(fields: Iterable[str] = CASE_FIELDS) -> Column:
    """SHA-256 of a row of texts as compact JSON with its fields in alphabetical order; null counts as empty."""
    parts = [F.concat(F.lit(json.dumps(f) + ":"), json_text(F.coalesce(F.col(f), F.lit("")))) for f in sorted(fields)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).cast("binary"), 256)


def set_fingerprint(df: DataFrame, fields: Iterable[str], order: str = "ordinal") -> str:
    """``stable_hash`` of the list of all rows in order. Rows stream through the driver one partition at a time; only a digest is kept."""
    names = sorted(fields)
    digest = hashlib.sha256(b"[")
    for n, row in enumerate(df.orderBy(order).select(*names).toLocalIterator()):
        digest.update(b"," * bool(n) + canonical(row.asDict(recursive=True)).encode())
    digest.update(b"]")
    return digest.hexdigest()
