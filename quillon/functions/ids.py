"""Identifiers: digests, name-based UUIDs, spreadsheet columns, boxes on a page."""

from __future__ import annotations

from uuid import UUID

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def uuid5(namespace: str, name: Column) -> Column:
    """The UUID of version 5, as Python's ``uuid.uuid5`` gives it."""
    h = F.sha1(F.concat(F.unhex(F.lit(UUID(namespace).hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def column_number(c: Column) -> Column:
    letters = F.filter(F.split(F.upper(c), ""), lambda x: x != "")
    return F.when(c.rlike("^[A-Za-z]{1,3}$"), F.aggregate(letters, F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64))


def column_letter(n: Column) -> Column:
    """Letters of columns 1 to 702."""
    low, high = F.pmod(n - 1, F.lit(26)), F.floor((n - 1) / 26).cast("int")
    return F.when(n.between(1, 702), F.concat(F.when(high > 0, F.char(high + 64)).otherwise(F.lit("")), F.char(low + 65)))


def within(x0: Column, x1: Column, low: float, high: float, tolerance: float = 3.0) -> Column:
    return (x0 >= low - tolerance) & (x1 <= high + tolerance)


def intersects(x0: Column, x1: Column, low: float, high: float, tolerance: float = 3.0) -> Column:
    return (x1 >= low - tolerance) & (x0 <= high + tolerance)


def share(value: Column, limit: Column) -> Column:
    """A coordinate as a share of the page, to a millionth, halves to even."""
    return F.bround(value / limit, 6).cast("decimal(8,6)")
