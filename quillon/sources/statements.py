"""Row classifiers of statements: PARSED, IGNORED or REJECTED with stable reason codes.

Each takes the wide rows of a sheet (or banded rows of printed pages) and adds outcome,
codes and the values; a row's outcome depends on its own cells, the markers above it and,
for the order of dates, on the valid rows above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import dates, money
from quillon.functions.text import ascii_label_key

_SHEET = ("source_id", "sheet_ordinal")


def _codes(*found: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), code) for code, test in found)))


def _blank(*columns: str) -> Column:
    test = F.lit(True)
    for c in columns:
        test &= F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0
    return test


def _falling(valid: Column, date: Column) -> Column:
    """Whether a date is after the earliest valid one above (rows go back in time)."""
    w = Window.partitionBy(*_SHEET).orderBy("row_number").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(date > F.min(F.when(valid, date)).over(w), F.lit(False))


def _alone(*tests: tuple[str, Column]) -> Column:
    """The first of some codes that keep all others away."""
    return F.coalesce(*(F.when(F.coalesce(test, F.lit(False)), F.array(F.lit(code))) for code, test in tests), F.array().cast("array<string>"))


def cartola(rows: DataFrame, first: int = 10) -> DataFrame:
    """Running statement: A date ``dd-mm-yyyy`` falling, B text, C series, D amount, E balance.

    A formula, else a cell that is no text, is the only code of its row; otherwise all errors
    are collected.  An empty or missing amount or balance is invalid.
    """
    rows = rows.withColumns({"date": dates.exact_date(F.trim("A"), "-"), "amount": money.grouped_amount(F.trim("D"), True), "balance": money.grouped_amount(F.trim("E"), True)})
    d, e = (money.grouped_code(F.trim(c), True) for c in "DE")
    alone = _alone(("formula_unsupported", F.col("has_formula")), ("cell_type_unsupported", F.col("has_other_type")))
    own = _codes(("date_invalid", F.col("date").isNull()), ("amount_invalid", d == "invalid"), ("amount_precision_overflow", d == "overflow"), ("balance_invalid", e == "invalid"), ("balance_precision_overflow", e == "overflow"))
    place = F.when(F.col("row_number") == 1, "title_row").when(F.col("row_number") < first - 2, "metadata_row").when(F.col("row_number") == first - 2, "separator_row").otherwise("header_row")
    return _collected(rows, alone, own, F.col("row_number") >= first, place, "source_date_order_invalid")


def recent(rows: DataFrame, first: int = 9) -> DataFrame:
    """Recent movements: A and B dates ``dd/mm/yyyy``, C text, G charge or H credit; codes as in ``cartola``."""
    amount = lambda c: money.grouped_amount(F.trim(c))
    rows = rows.withColumns({"date": dates.exact_date(F.trim("A"), "/"), "accounting_date": dates.exact_date(F.trim("B"), "/"), "charge": amount("G"), "credit": amount("H")})
    one = _blank("G") != _blank("H")
    alone = _alone(("formula_unsupported", F.col("has_formula")), ("cell_type_unsupported", F.col("has_other_type")))
    own = _codes(("date_invalid", F.col("date").isNull()), ("accounting_date_invalid", F.col("accounting_date").isNull()), ("direction_xor_invalid", ~one), ("amount_invalid", one & F.coalesce("charge", "credit").isNull()))
    return _collected(rows, alone, own, F.col("row_number") >= first, F.when(F.col("row_number") < first - 1, "metadata_row").otherwise("header_row"), "transaction_date_order_invalid")


def _collected(rows: DataFrame, alone: Column, own: Column, data: Column, place: Column, late_code: str) -> DataFrame:
    rows = rows.withColumn("__alone", alone).withColumn("__own", own)
    late = _falling(data & (F.size("__alone") == 0) & (F.size("__own") == 0), F.col("date"))
    every = F.when(F.size("__alone") > 0, F.col("__alone")).otherwise(F.concat("__own", F.array_compact(F.array(F.when(late, late_code)))))
    return _decided(rows.withColumn("__all", every).drop("__alone"), data, place)


def _decided(rows: DataFrame, data: Column, place: Column) -> DataFrame:
    outcome = F.when(~data, "IGNORED").when(F.size("__all") == 0, "PARSED").otherwise("REJECTED")
    return rows.withColumn("outcome", outcome).withColumn("codes", F.when(data, F.col("__all")).otherwise(F.array(place))).drop("__own", "__all")


#: Labels of header cells and of the rows that begin and end the commission summary.
LABELS = {
    "A": ["date", "fecha", "fechamovimiento", "fechaoperacion"],
    "C": ["description", "descripcion", "detalle", "glosa", "concepto"],
    "E": ["debit", "cargo", "cargos", "debe"],
    "F": ["credit", "abono", "abonos", "haber"],
    "G": ["balance", "saldo"],
}
PART_LABELS = {"E": ["cargo", "debit"], "F": ["abono", "credit"]}
COMMISSION_MARK, POST_MARK = "resumendecomisiones", "mensajes"


def current(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """Current account: A date, C text, D reference, E debit, F credit, G balance, under a header row.

    ``periods`` has source_id, period_start and period_end; ``types`` of the rows, if there,
    maps letters to the cells' kinds (text, n, b, date).  One code decides, by order: blank,
    repeated header, formula, auxiliary (neither a date nor an amount), both sides, no amount,
    amount, date.  From a row that holds just the commission heading on rows are ignored.
    """
    key = lambda c: ascii_label_key(F.coalesce(F.col(c), F.lit("")))
    typed = "types" in rows.columns
    kind = lambda c: F.coalesce(F.col("types")[c], F.lit("text")) if typed else F.lit("text")
    letters = "ABCDEFG"
    header = F.lit(True)
    for c, names in LABELS.items():
        label = key(c)
        header &= label.isin(names) | (label.rlike("|".join(PART_LABELS[c])) if c in PART_LABELS else F.lit(False))
    mark = lambda c, label: (key(c) == label) & _blank(*(x for x in letters if x != c))
    rows = rows.withColumns({"__header": header, "__commission": mark("C", COMMISSION_MARK), "__post": mark("A", POST_MARK)})
    w, n = Window.partitionBy(*_SHEET), F.col("row_number")
    rows = rows.withColumn("__first", F.min(F.when(F.col("__header"), n)).over(w))
    rows = rows.withColumn("__stop", F.min(F.when(F.col("__commission") & (n > F.col("__first")), n)).over(w))
    rows = rows.withColumn("__end", F.min(F.when(F.col("__post") & (n > F.col("__stop")), n)).over(w))
    rows = rows.join(periods, "source_id", "left")
    day, of_a = F.trim("A"), kind("A")
    whole = F.when(of_a == "date", day.try_cast("date")).otherwise(dates.full_date(day))
    dated = (of_a.isin("date", "n")) | F.coalesce(day.rlike(dates.DAY_MONTH) | day.rlike(r"^[0-9]{1,4}[/-][0-9]{1,2}[/-][0-9]{1,4}$"), F.lit(False))
    rows = rows.withColumns({
        "__dated": dated, "__whole": whole, "__short": dates.resolved(day, F.col("period_start"), F.col("period_end")),
        "__debit": money.sheet_cell(F.col("E"), kind("E")), "__credit": money.sheet_cell(F.col("F"), kind("F")), "__balance": money.sheet_cell(F.col("G"), kind("G"), movement=False),
    })
    side = F.when(~_blank("E"), F.col("__debit")).otherwise(F.col("__credit"))
    outside = F.when(~F.col("__whole").between(F.col("period_start"), F.col("period_end")), "date_outside_period")
    date_code = (
        F.when(F.col("__whole").isNotNull(), outside)
        .when(F.col("A").isNull() | ~of_a.isin("text", "date"), "date_unsupported")
        .when(day.rlike(dates.DAY_MONTH), F.col("__short.code"))
        .otherwise("date_invalid")
    )
    ignored = (
        F.when(F.col("__first").isNull() | (n < F.col("__first")), "metadata_row")
        .when(n == F.col("__first"), "header_row")
        .when(n == F.col("__stop"), "commission_summary_section")
        .when(n == F.col("__end"), "post_summary_section")
        .when(n > F.col("__end"), "auxiliary_row")
        .when(n > F.col("__stop"), "commission_summary")
        .when(_blank(*letters), "blank_row")
        .when(F.col("__header"), "repeated_header")
        .when(~F.coalesce("has_formula", F.lit(False)) & ~F.col("__dated") & _blank("E", "F", "G"), "auxiliary_row")
    )
    rejected = (
        F.when(F.col("has_formula"), "formula_unsupported")
        .when(~_blank("E") & ~_blank("F"), "debit_credit_conflict")
        .when(_blank("E", "F"), "amount_missing")
        .otherwise(F.coalesce(side["code"], date_code))
    )
    rows = rows.withColumns({"__ignored": ignored, "__rejected": rejected})
    outcome = F.when(F.col("__ignored").isNotNull(), "IGNORED").when(F.col("__rejected").isNotNull(), "REJECTED").otherwise("PARSED")
    # the contract's warning; the row stays
    warning = F.when(~_blank("G") & F.col("__balance.code").isNotNull(), "running_balance_invalid")
    rows = rows.withColumn("outcome", outcome)
    parsed = F.col("outcome") == "PARSED"
    rows = rows.withColumns({
        "codes": F.when(parsed, F.array_compact(F.array(warning))).otherwise(F.array(F.coalesce("__ignored", "__rejected"))),
        "date": F.when(parsed, F.coalesce("__whole", "__short.value")),
        "signed_amount": F.when(parsed, F.when(~_blank("E"), -F.col("__debit.value")).otherwise(F.col("__credit.value"))),
        "running_balance": F.when(parsed, F.col("__balance.value")),
    })
    return rows.drop(*(c for c in rows.columns if c.startswith("__")))


def historical(rows: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """Printed historical statement, from the rows of ``historical.documents`` (doc_id, page, row),
    or of ``historical.rows``, which have their periods: the first code in order of precedence
    rejects.  A blank inside an amount means that it was printed as several tokens."""
    rows = rows if periods is None else rows.join(periods, "doc_id", "left")
    amounts = ("debit", "credit", "balance")
    rows = rows.withColumns({"__date": dates.exact_date(F.col("date"), "/"), **{f"__{c}": money.grouped_amount(F.col(c), True) for c in amounts}})
    rows = rows.withColumns({f"__{c}_code": F.when(F.col(c).isNotNull(), money.grouped_code(F.col(c), True, F.col(f"__{c}"))) for c in amounts})
    inside = F.col("__date").between(F.col("period_start"), F.col("period_end"))
    w = Window.partitionBy("doc_id").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, -1)
    is_ = lambda code, *of: F.greatest(*(F.coalesce(F.col(f"__{c}_code") == code, F.lit(False)) for c in of), F.lit(False))
    amount_code = (
        F.when(F.concat_ws("", *amounts).contains(" "), "row_geometry_ambiguous")
        .when(is_("overflow", *amounts), "money_precision_overflow")
        .when(is_("invalid", "debit", "credit"), "amount_invalid")
        .when(is_("invalid", "balance"), "running_balance_invalid")
        .when(F.coalesce("debit", "credit").isNull(), "amount_missing")
        .when(F.col("debit").isNotNull() & F.col("credit").isNotNull(), "amount_both_sides")
        .when(F.coalesce("__debit", "__credit") < 0, "negative_directional_amount")
        .when(F.coalesce("__debit", "__credit") == 0, "zero_amount_unsupported")
        .when(F.col("balance").isNull(), "running_balance_missing")
    )
    rows = rows.withColumn("__amount", amount_code)
    latest = F.max(F.when(inside & F.col("__amount").isNull(), F.col("__date"))).over(w)
    code = F.when(F.col("__date").isNull(), "date_invalid").when(~inside, "date_outside_period").when(F.col("__date") < latest, "date_order_invalid").otherwise(F.col("__amount"))
    rows = rows.withColumn("__code", code)
    signed = (F.coalesce("__credit", F.lit(0)) - F.coalesce("__debit", F.lit(0))).cast("decimal(20,2)")
    return rows.select(
        "doc_id", "page", "row", "line", F.col("__date").alias("date"), "description", F.when(F.col("__code").isNull(), signed).alias("signed_amount"), F.col("__debit").alias("debit"), F.col("__credit").alias("credit"), F.col("__balance").alias("balance"),
        F.when(F.col("__code").isNull(), "PARSED").otherwise("REJECTED").alias("outcome"), F.array_compact(F.array("__code")).alias("codes"),
    )
