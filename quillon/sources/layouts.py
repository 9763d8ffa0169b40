"""Which sheet of a workbook holds a statement, and what its head says.

A layout is a table of places and labels that a sheet must have.  Sheets are divided by it:
those stay that have every place, and no other where the layout is exclusive; then merged
ranges and extent are tested, and exactly one visible sheet has to be left.  All of it is
joins and counts over cells (``cells.xlsx_cells``), so a workbook is never one task's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import dates, money
from quillon.functions.text import quick_collapsed_label, quick_label_key
from quillon.operators.shared import held
from quillon.sources.statements import LABELS, PART_LABELS

#: Labels of the heads, from the top.
BALANCES = ["saldo disponible", "saldo contable", "retenciones", "sobregiro disponible", "sobregiro utilizado", "linea de emergencia"]
#: Places (row, column, label; null for any content) of a layout.
PLACES = {
    "cartola": [(1, "A", "movimientos de su cuenta"), *((n, "B", t) for n, t in enumerate(BALANCES, 2)), *((n, "C", None) for n in range(2, 8)), *((9, c, t) for c, t in zip("ABCDE", ["fecha", "descripcion", "serie", "monto $", "saldo contable $"], strict=True))],
    "recent": [(1, "A", "ultimos movimientos"), *((n, "D", t) for n, t in enumerate(BALANCES, 2)), *((8, c, t) for c, t in [("A", "fecha transaccion"), ("B", "fecha contable"), ("C", "descripcion"), ("G", "cargo $"), ("H", "abono $")])],
}
#: Per layout: its last row before the data, its columns, whether its head has no other cells, and the code where no sheet fits.
SHAPES = {"cartola": (9, 5, True, "current_cartola_header_not_found"), "recent": (8, 8, False, "movement_header_not_found")}
_SHEET = ["source_id", "sheet_ordinal"]


def _column(c: Column) -> Column:
    """A column's number by its letters; up to three, as all sheets have, in compiled code."""
    digit = lambda k: F.ascii(F.substring(c, k, 1)) - 64
    many = F.aggregate(F.split(c, ""), F.lit(0), lambda n, x: F.when(x == "", n).otherwise(n * 26 + F.ascii(x) - 64))
    return F.when(F.length(c) == 1, digit(1)).when(F.length(c) == 2, digit(1) * 26 + digit(2)).when(F.length(c) == 3, (digit(1) * 26 + digit(2)) * 26 + digit(3)).otherwise(many)


def match(cells: DataFrame, layout: str) -> DataFrame:
    """A row for each source: ``sheet_ordinal`` and ``sheet_name`` of its statement, or ``code``.

    First counts which visible sheets fit: none, or several, or one among other sheets
    where only one may be.  Then how the one is filled: an empty row, a column
    that isn't the layout's, a formula or a cell that is no text in its head.
    """
    head, width, alone, missing = SHAPES[layout]
    spark = cells.sparkSession
    places = spark.createDataFrame(PLACES[layout], "p_row int, p_column string, p_label string")
    sheets = cells.filter("sheet_ordinal IS NOT NULL")
    there = F.coalesce(F.expr("row_number IS NOT NULL AND (is_formula OR value_text IS NOT NULL)"), F.lit(False))
    sheets = sheets.withColumns({"there": there, "in_head": there & (F.coalesce("row_number", F.lit(head + 1)) <= head), "n_column": F.when(there, _column(F.col("column")))})
    # a formula has no label
    sheets = sheets.withColumn("label", F.when(F.col("in_head") & ~F.col("is_formula"), quick_collapsed_label("value_text")))
    at = (F.col("row_number") == F.col("p_row")) & (F.col("column") == F.col("p_column"))
    hit = F.col("p_row").isNotNull() & (F.col("p_label").isNull() | (F.col("label") == F.col("p_label")))
    text, pair = F.col("value_text"), "^C([0-9]+):F\\1$"
    merge, counted = F.col("value_type") == "merge", {}
    counted |= {"hits": F.col("in_head") & hit, "heads": F.col("in_head"), "formulas": F.col("in_head") & F.col("is_formula"), "other_types": F.col("in_head") & (F.col("value_type") != "text") & text.isNotNull() & ~F.col("is_formula")}
    counted |= {"between": F.col("in_head") & (F.col("row_number") == head) & F.col("column").isin("D", "E", "F") & (F.coalesce("label", F.lit("")) != "")}
    counted |= {"merges": merge, "narrow_title": merge & (text == "A1:E1"), "wide_title": merge & (text == "A1:H1"), "odd_merges": merge & (text != "A1:H1") & ~text.rlike(pair), "cells": F.col("there")}
    # cells are read once: rows first, so that those of a sheet can be counted; a mask tells the columns apart where a sheet is narrow enough to fit
    mask = F.bit_or(F.when(F.col("n_column").between(0, 62), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("n_column"))))
    rows = sheets.join(F.broadcast(places), at, "left").groupBy(*_SHEET, "row_number").agg(
        *(F.count_if(c).alias(k) for k, c in counted.items()), F.max("n_column").alias("widest"), mask.alias("mask"), F.min("sheet_name").alias("sheet_name"), F.bool_and("visible").alias("visible"),
        F.collect_set(F.when(merge & text.rlike(pair), F.regexp_extract("value_text", "^C([0-9]+):", 1).cast("int"))).alias("merged_rows"),
    )
    every = rows.groupBy(*_SHEET).agg(
        *(F.sum(k).alias(k) for k in counted if k not in ("heads", "cells")), F.sum("heads").alias("in_head"), F.count_if(F.col("cells") > 0).alias("rows"), F.max(F.when(F.col("cells") > 0, F.col("row_number"))).alias("last"), F.max("widest").alias("widest"),
        F.bit_count(F.coalesce(F.bit_or("mask"), F.lit(0).cast("bigint"))).alias("columns"), F.coalesce(F.min(F.when(F.col("row_number").isNotNull(), F.col("sheet_name"))), F.min("sheet_name")).alias("sheet_name"), F.bool_and("visible").alias("visible"), F.array_distinct(F.flatten(F.collect_list("merged_rows"))).alias("merged_rows"),
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    n_places = len(PLACES[layout])
    fits = (z("hits") == n_places) & F.col("visible")
    if layout == "cartola":
        fits &= (z("in_head") == n_places) & (z("last") >= head + 1) & (z("widest") == width) & (z("merges") == 1) & (z("narrow_title") == 1)
        rows = z("rows") != z("last") - 1  # but for the separator
    else:
        merged = F.coalesce(F.col("merged_rows"), F.array().cast("array<int>"))
        needed = F.sequence(F.lit(head + 1), F.greatest(z("last"), F.lit(head + 1)))
        inside = F.forall(merged, lambda r: (r >= head) & (r <= F.col("last")))
        fits &= (F.col("sheet_name") == "movimientos") & (z("wide_title") == 1) & (z("between") == 0) & (z("last") >= head + 1) & (z("widest") <= width) & (z("odd_merges") == 0) & inside & (F.size(F.array_except(needed, merged)) == 0)
        rows = z("rows") != z("last")
    code = F.when(rows, "unexpected_empty_row").when((z("columns") != width) & F.lit(alone), "column_geometry_unsupported").when(z("formulas") > 0, "formula_unsupported").when(z("other_types") > 0, "cell_type_unsupported")
    every = every.withColumns({"fits": F.coalesce(fits, F.lit(False)), "own": code})
    found = every.groupBy("source_id").agg(F.count("*").alias("sheets"), F.count_if("fits").alias("n"), F.min_by(F.struct("sheet_ordinal", "sheet_name", "own"), F.when(F.col("fits"), F.col("sheet_ordinal"))).alias("one"))
    whole = F.when(F.col("n") == 0, missing).when(F.col("n") > 1, "ambiguous_statement_worksheets").when((F.col("sheets") != 1) & F.lit(alone), "worksheet_count_unsupported").otherwise(F.col("one.own"))
    refused = cells.filter("code IS NOT NULL").select("source_id", F.lit(None).cast("int").alias("sheet_ordinal"), F.lit(None).cast("string").alias("sheet_name"), "code")
    found = found.withColumn("code", whole)
    return found.select("source_id", F.when(F.col("code").isNull(), F.col("one.sheet_ordinal")).alias("sheet_ordinal"), F.when(F.col("code").isNull(), F.col("one.sheet_name")).alias("sheet_name"), "code").unionByName(refused)


#: Labels of a current account's period and balances.
PERIOD = {"start": ["start", "desde", "periodstart", "fechainicio", "startdate"], "end": ["end", "hasta", "periodend", "fechafin", "enddate"]}
EDGES = {"opening": ["openingbalance", "saldoinicial"], "ending": ["endingbalance", "saldofinal"]}


def discover_current(cells: DataFrame) -> DataFrame:
    """A row for each source with a current account's statement: ``sheet_ordinal``, ``header_row``,
    period_start, period_end, opening_balance and ending_balance, or ``code``.

    The statement is the only visible sheet with a header row (and nothing right of column G
    in it).  A period's day is the first date to the right of its label above the header; a
    formula on the way there refuses the workbook, as do no or several starts or ends.  A
    balance is the first amount to the right of its label in column A.
    """
    there = F.coalesce(F.expr("code IS NULL AND row_number IS NOT NULL AND (is_formula OR trim(value_text) <> '')"), F.lit(False))
    present = cells.withColumns({"n_column": F.when(there, _column(F.col("column"))), "key": F.when(there & ~F.col("is_formula"), quick_label_key("value_text"))})
    is_ = {c: F.col("key").isin(names) | (F.col("key").rlike("|".join(PART_LABELS[c])) if c in PART_LABELS else F.lit(False)) for c, names in LABELS.items()}
    named = reduce(Column.__or__, ((F.col("column") == c) & test for c, test in is_.items()))
    near = F.collect_list(F.when(F.col("n_column") <= 7, F.struct("n_column", "is_formula", "key", "value_type", "value_text")))
    # held, as cells are dear to read: sources, headers and heads all come from their rows
    rows = held(present.groupBy(*_SHEET, "row_number").agg(F.count_if(F.coalesce(named & F.col("visible"), F.lit(False))).alias("hits"), F.max(F.when(F.col("visible"), F.col("n_column"))).alias("widest"), near.alias("near"), F.max("code").alias("code")))
    headers = rows.filter((F.col("hits") == len(LABELS)) & (F.col("widest") <= 7)).groupBy(*_SHEET).agg(F.min("row_number").alias("header_row"))
    one = headers.groupBy("source_id").agg(F.count("*").alias("n"), F.min("sheet_ordinal").alias("sheet_ordinal"), F.min("header_row").alias("header_row"))
    sources = rows.groupBy("source_id").agg(F.max("code").alias("refused"))
    # a row for each source, or several: whatever their size is thought to be, no side goes through the driver
    found = sources.join(one.hint("merge"), "source_id", "left")
    every_label = [x for names in (*PERIOD.values(), *EDGES.values()) for x in names]
    labelled = rows.filter(F.exists("near", lambda x: x["key"].isin(every_label)))
    head = labelled.join(one.filter("n = 1").drop("n").hint("merge"), _SHEET).filter(F.col("row_number") < F.col("header_row")).select("source_id", "row_number", F.inline("near"))
    day = F.when(F.col("value_type") == "date", F.col("value_text").try_cast("date")).when(F.col("value_type") == "text", dates.full_date(F.trim("value_text")))
    balance = money.sheet_cell(F.col("value_text"), F.col("value_type"), movement=False)
    target = F.expr("CASE " + " ".join(f"WHEN key IN ({', '.join(repr(x) for x in names)}) THEN '{k}'" for k, names in PERIOD.items()) + " END")
    edge = F.expr("CASE " + " ".join(f"WHEN key IN ({', '.join(repr(x) for x in names)}) THEN '{k}'" for k, names in EDGES.items()) + " END")
    head = head.withColumns({"day": F.when(~F.col("is_formula"), day), "money": F.when(~F.col("is_formula"), balance["value"]), "target": target, "edge": F.when(F.col("n_column") == 1, edge)})
    place = ["source_id", "row_number"]
    right = Window.partitionBy(*place).orderBy("n_column").rangeBetween(1, Window.unboundedFollowing)
    first = lambda test, *columns: F.first(F.when(test, F.struct(*columns)), ignorenulls=True).over(right)
    head = head.withColumns({"dated": first(F.col("is_formula") | F.col("day").isNotNull(), "is_formula", "day"), "valued": first(F.col("money").isNotNull(), "n_column", "money")})
    dated = head.filter("target IS NOT NULL AND dated IS NOT NULL").groupBy(*place, "n_column", "target").agg(F.first("dated.is_formula").alias("formula"), F.first("dated.day").alias("value"))
    is_target = lambda t: (F.col("target") == t) & F.col("value").isNotNull()
    period = dated.groupBy("source_id").agg(
        F.bool_or("formula").alias("formula"), *(F.count_if(is_target(t)).alias(f"n_{t}") for t in PERIOD), *(F.min(F.when(is_target(t), F.col("value"))).alias(f"period_{t}") for t in PERIOD)
    )
    at = F.struct("row_number", "valued.n_column")
    edges = head.filter("edge IS NOT NULL AND valued IS NOT NULL").groupBy("source_id").agg(*(F.min_by("valued.money", F.when(F.col("edge") == k, at)).alias(f"{k}_balance") for k in EDGES))
    found = found.join(period.hint("merge"), "source_id", "left").join(edges.hint("merge"), "source_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    code = (
        F.when(F.col("refused").isNotNull(), F.col("refused")).when(z("n") == 0, "movement_header_not_found").when(F.col("n") > 1, "ambiguous_statement_worksheets")
        .when(F.coalesce("formula", F.lit(False)), "formula_unsupported").when((z("n_start") == 0) | (z("n_end") == 0), "period_context_missing").when((z("n_start") > 1) | (z("n_end") > 1), "period_context_ambiguous")
        .when(F.col("period_start") > F.col("period_end"), "period_context_invalid")
    )
    found = found.withColumn("code", code)
    kept = ("sheet_ordinal", "header_row", "period_start", "period_end", "opening_balance", "ending_balance")
    return found.select("source_id", *(F.when(F.col("code").isNull(), F.col(c)).alias(c) for c in kept), "code")
