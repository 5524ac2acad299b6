"""Fingerprints and deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(ts: Column) -> Column:
    """An instant in UTC with six digits after the second."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def json_text(value: Column) -> Column:
    """A JSON string literal, with the escapes of the short form; null is `null`.

    Characters outside ASCII are written as \\uXXXX escapes, by UTF-16 unit.
    """
    quoted = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, short in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\x08", "b"), ("\x0c", "f")):
        quoted = F.replace(quoted, F.lit(raw), F.lit("\\" + short))
    units = F.hex(F.encode(quoted, "UTF-16BE"))
    each = F.transform(F.sequence(F.lit(0), (F.length(units) / 4).cast("int") - 1), lambda i: F.substr(units, i * 4 + 1, F.lit(4)))
    escaped = F.array_join(F.transform(each, lambda u: F.when((u < "0020") | (u > "007E"), F.concat(F.lit("\\u"), F.lower(u))).otherwise(F.decode(F.unhex(u), "UTF-16BE"))), "")
    body = F.when(quoted.rlike("^[\\x20-\\x7e]*$"), quoted).otherwise(escaped)
    return F.coalesce(F.concat(F.lit('"'), body, F.lit('"')), F.lit("null"))


def fingerprint(*fields: Column) -> Column:
    """SHA-256 of the compact JSON array of the given JSON texts."""
    parts = [p for i, f in enumerate(fields) for p in ([F.lit(",")] if i else []) + [f]]
    return F.sha2(F.concat(F.lit("["), *parts, F.lit("]")), 256)


#: Fixed value: the namespace of slot identifiers.
NAMESPACE = "3c01f3f5afd64363b726a5dab51a81c7"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """Version 5 UUID of a name: SHA-1 with the version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def slot_id(schedule: Column, slot: Column, namespace: str = NAMESPACE) -> Column:
    """Identifier of a schedule's slot: the same in every run."""
    return uuid5(F.concat(schedule, F.lit(":"), canonical(slot)), namespace)


def advisory_key(text: Column) -> Column:
    """First eight bytes of the SHA-256, as a signed number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, -10).cast("bigint")
