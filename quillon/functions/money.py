"""Exact money: texts are checked by their grammar before they are cast, as casts round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(20,2)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def exact_code(c: Column) -> Column:
    """Null for a decimal text of at most 18 whole digits and 2 decimals, else a code."""
    digits = F.regexp_replace(F.regexp_extract(c, r"^-?([0-9]+)(\.[0-9]+)?$", 1), "^0+(?=[0-9])", "")
    return (
        F.when(c.isNull() | ~c.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.lit("money_not_finite"))
        .when(c.rlike(r"\.[0-9]{3,}$"), F.lit("money_scale_exceeded"))
        .when(F.length(digits) > 18, F.lit("money_precision_exceeded"))
    )


def exact(c: Column) -> Column:
    return F.when(exact_code(c).isNull(), c.try_cast(MONEY))


def sheet_amount(c: Column) -> Column:
    """Struct (value, code) of an unsigned amount in a spreadsheet's text.

    With both separators the last is the decimal one, with one or two digits after it and
    groups of three before; one separator that repeats, or has three digits after it,
    groups; with one or two digits it is the decimal one.
    """
    clean = F.regexp_replace(F.regexp_replace(c, "[\u00a0\\s]", ""), r"^([-(]?)\$", "$1")
    return let(clean, lambda t: let(_sheet_number(t), lambda n: let(exact(n), lambda value: _sheet_result(t, value))))


def _sheet_number(t: Column) -> Column:
    """Plain decimal text of an amount; null if its separators don't follow the rules."""
    return (
        F.when(t.rlike(r"^[0-9]+$"), t)
        .when(t.rlike(r"^[0-9]+(\.[0-9]{3})*,[0-9]{1,2}$") & t.contains("."), F.translate(F.translate(t, ".", ""), ",", "."))
        .when(t.rlike(r"^[0-9]+(,[0-9]{3})*\.[0-9]{1,2}$") & t.contains(","), F.translate(t, ",", ""))
        .when(t.rlike(r"^[0-9]+(\.[0-9]{3})+$|^[0-9]+(,[0-9]{3})+$"), F.translate(t, ".,", ""))
        .when(t.rlike(r"^[0-9]+[.,][0-9]{1,2}$"), F.translate(t, ",", "."))
    )


def _sheet_result(t: Column, value: Column) -> Column:
    code = (
        F.when(F.coalesce(F.length(t), F.lit(0)) == 0, F.lit("amount_missing"))
        .when(t.startswith("-") | t.startswith("("), F.lit("negative_source_amount"))
        .when(value.isNull(), F.lit("amount_invalid"))
        .when(value == 0, F.lit("zero_amount_unsupported"))
    )
    return F.struct(value.alias("value"), code.alias("code"))


def token_amount(c: Column, grouped: Column | None = None) -> Column:
    """Money printed on a card statement: a point groups beside a comma, and alone only
    where ``grouped`` holds; parentheses or a minus make it negative."""
    t = F.regexp_replace(c, r"[$\s]", "")
    minus = t.rlike(r"^\(.*\)$|^-")
    t = F.regexp_replace(t, r"[()\-]", "")
    groups = F.lit(False) if grouped is None else grouped
    plain = (
        F.when(t.contains(",") & t.contains("."), F.translate(F.translate(t, ".", ""), ",", "."))
        .when(t.contains(","), F.translate(t, ",", "."))
        .when(groups, F.translate(t, ".", ""))
        .otherwise(t)
    )
    return F.when(plain.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.concat(F.when(minus, F.lit("-")).otherwise(F.lit("")), plain))


def grouped_amount(c: Column, signed: bool = False) -> Column:
    """Whole amounts, plain or with points between groups of three; null if malformed, or with
    more than 18 digits: the cast of a text of this grammar rounds nothing."""
    return F.when(_is_grouped(c, signed), F.translate(c, ".", "").try_cast(MONEY))


def _is_grouped(c: Column, signed: bool) -> Column:
    sign = "-?" if signed else ""
    return c.rlike(rf"^{sign}([0-9]+|[0-9]{{1,3}}(\.[0-9]{{3}})+)$")


def sheet_cell(c: Column, kind: Column, movement: bool = True) -> Column:
    """Struct (value, code) of a cell's unsigned amount, a number or a text.

    Numbers count as they are, with a code where they have more than two decimals; a flag or
    a date is no amount.  Zero is one only for a balance.
    """
    number = F.when(kind == "n", c.try_cast("decimal(38,10)"))
    of_number = F.struct(
        number.try_cast(MONEY).alias("value"),
        F.when(number.isNull(), "amount_invalid").when(number < 0, "negative_source_amount").when(number != F.round(number, 2), "money_scale_exceeded").when(F.abs(number) >= F.lit("1e18").cast("decimal(38,10)"), "money_precision_exceeded").when(number == 0, "zero_amount_unsupported").alias("code"),
    )
    other = F.struct(F.lit(None).cast(MONEY).alias("value"), F.lit("amount_invalid").alias("code"))
    found = F.when(kind == "n", of_number).when(F.coalesce(kind, F.lit("text")) == "text", sheet_amount(c)).otherwise(other)

    def result(x: Column) -> Column:
        code = x["code"] if movement else F.nullif(x["code"], F.lit("zero_amount_unsupported"))
        return F.struct(F.when(code.isNull(), x["value"]).alias("value"), code.alias("code"))

    return let(found, result)


def grouped_code(c: Column, signed: bool = False, read: Column | None = None) -> Column:
    """Why ``grouped_amount`` (``read``, if it is a column already) is null: ``invalid`` (also
    for null) or ``overflow``."""
    amount = grouped_amount(c, signed) if read is None else read
    return F.when(amount.isNull(), F.when(_is_grouped(c, signed), "overflow").otherwise("invalid"))


def movement_code(c: Column) -> Column:
    """Code of a money text that is to be a movement."""
    return F.coalesce(exact_code(c), F.when(exact(c) == 0, F.lit("movement_amount_zero")))


def shown(c: Column) -> Column:
    """Display form: points between groups, decimals after a comma unless they are zero."""
    text = F.translate(F.format_number(F.abs(c), 2), ",.", ".,")
    sign = F.when(c < 0, F.lit("−")).when(c > 0, F.lit("+")).otherwise(F.lit(""))
    return F.concat(sign, F.regexp_replace(text, ",00$", ""))
