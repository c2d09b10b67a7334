"""Identities, digests and canonical text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Namespaces of derived identities.
SNAPSHOT_NAMESPACE = "6f9b2c1e-6a4d-5c8e-9f10-2b7d4e6a8c30"
EVALUATION_NAMESPACE = "3d5c8a2f-7b41-5e96-8c03-1a9f4d2e7b58"
DECOMPOSITION_NAMESPACE = "b47e1d90-5c62-5a1f-9e84-3f70c6b28d15"
PREDICTION_NAMESPACE = "0f5b7a52-2c1d-5b0e-8d8e-6f2f3f1f9c11"

#: Times to the microsecond.
EXACT_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"
_JSON = {"ignoreNullFields": "false", "timestampFormat": EXACT_TIME, "timestampNTZFormat": EXACT_TIME.removesuffix("xxx"), "writeNonAsciiCharacterAsCodePoint": "true"}


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def _exact(field: T.StructField) -> Column:
    """A column as its canonical text has it."""
    c = F.col(field.name)
    if isinstance(field.dataType, T.TimestampType):
        return F.regexp_replace(F.date_format(c, EXACT_TIME), "[.]0{6}(?=[+-])", "")
    if isinstance(field.dataType, T.TimestampNTZType):
        return F.regexp_replace(F.date_format(c, _JSON["timestampNTZFormat"]), "[.]0{6}$", "")
    if isinstance(field.dataType, T.DecimalType):
        return c.cast("string")
    return F.lower(F.hex(c)) if isinstance(field.dataType, T.BinaryType) else c


def canonical_json(rows: DataFrame, *names: str) -> Column:
    """Compact JSON of columns of ``rows``, keys sorted and ASCII-escaped; nulls are written, so null and absent differ.

    A time is ISO text with its microseconds, without a fraction where there is none; a decimal is text with all digits of
    its scale, binary is hexadecimal text; within arrays and structs, times always have six digits, decimals are numbers and
    binary is base 64. NaN and the infinities fail the job.
    """
    kinds = {f.name: f for f in rows.schema}
    text = F.to_json(F.struct(*(_exact(kinds[n]).alias(n) for n in sorted(names))), _JSON)
    # of numbers only those without a number's text are written in quotes
    refused = [F.when(F.to_json(F.struct(n)).endswith('"}'), F.lit(n)) for n in sorted(names) if isinstance(kinds[n].dataType, (T.DoubleType, T.FloatType))]
    if not refused:
        return text
    bad = F.coalesce(*refused)
    return F.when(bad.isNull(), text).otherwise(F.raise_error(F.concat(F.lit("NaN has no canonical form: "), bad)))


def row_digest(rows: DataFrame, *names: str) -> Column:
    """Digest of a row's content; leave out the columns that say how the row got there."""
    return sha256(canonical_json(rows, *names))


def uuid5(namespace: str, key: Column) -> Column:
    """The name-based identity (version 5) of ``key`` in a namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(key, "UTF-8")))

    def written(x: Column) -> Column:
        variant = F.lower(F.hex((F.conv(F.substring(x, 17, 1), 16, 10).cast("int") % 4 + 8).cast("long")))
        part = lambda at, n: F.substring(x, at, n)
        return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))

    return F.get(F.transform(F.array(h), written), F.lit(0))  # the hash of a long key stands in the plan once


def joined_key(*parts: Column | str) -> Column:
    """Parts with a bar between them, null as nothing."""
    return F.concat_ws("|", *(F.coalesce(p if isinstance(p, Column) else F.lit(p), F.lit("")) for p in parts))


def subject_id(line: Column, occurrence: Column) -> Column:
    return F.substring(sha256(F.concat(line, F.lit("#"), occurrence.cast("string"))), 1, 16)


def _number(c: Column, at: int, n: int) -> Column:
    return F.conv(F.substring(c, at, n), 16, 10).cast("long")


SPLITS = ("train", "eval", "holdout")


def split_of(subject: Column) -> Column:
    """Train, eval or holdout by the identity alone. 70, 15 and 15 in a hundred, by the first 8 digits."""
    x = _number(subject, 1, 8) % 100
    return F.when(x < 70, SPLITS[0]).when(x < 85, SPLITS[1]).otherwise(SPLITS[2])


def event_time(subject: Column) -> Column:
    """A pseudo event time from the identity alone. 730 days from 2024-01-01 UTC, digits 9-12 and 13-16."""
    seconds = (_number(subject, 9, 4) % 730) * 86400 + _number(subject, 13, 4) % 86400
    return F.timestamp_seconds(F.lit(1704067200) + seconds)


def bucket_of(subject: Column, buckets: int = 16) -> Column:
    return F.pmod(F.xxhash64(subject), F.lit(buckets)).cast("int")
