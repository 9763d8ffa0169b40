"""Registered queries of sheets' layouts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.catalogue import query, table
from quillon.sources import layouts

_KIND = "array<struct<sheet_ordinal:int,sheet_name:string,visible:boolean,row_number:int,column:string,value_type:string,value_text:string,is_formula:boolean>>"


def _cell(row, column, text, *, sheet=0, name="movimientos", visible=None, kind="text", formula=None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(sheet).alias("sheet_ordinal"), lit(name).alias("sheet_name"), lit(True if visible is None else visible).alias("visible"), lit(row).cast("int").alias("row_number"), lit(column).cast("string").alias("column"),
        lit(kind).alias("value_type"), lit(text).cast("string").alias("value_text"), lit(False if formula is None else formula).alias("is_formula"),
    )


def _spread(rows: DataFrame, key: str, cells: list[Column]) -> DataFrame:
    found = rows.select(F.col(key).alias("source_id"), F.inline(F.array_compact(F.array(*cells)).cast(_KIND)))
    return found.withColumn("code", F.lit(None).cast("string"))


def _sheets(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    """Every order as a workbook of the layout with two rows of data, and one fault by its number."""
    k = F.col("o_orderkey")
    v = k % 17
    rows = table(spark, sf_dir, "orders")
    head, width, _, _ = layouts.SHAPES[layout]
    last = "E" if layout == "cartola" else "H"
    merge = lambda text: _cell(None, None, text, kind="merge")
    name = F.when((v == 1) & F.lit(layout == "recent"), "otra").otherwise("movimientos")
    cells = []
    for row, column, label in layouts.PLACES[layout]:
        text = F.concat(F.lit(" "), F.upper(F.lit(label or "x")))
        text = F.when((v == 2) & F.lit(row == 1), "otro").otherwise(text)
        fault = (v == 3) & F.lit(row == 3 and label is not None)
        kind = F.when((v == 4) & F.lit(row == 2 and label is None), "n").otherwise("text")
        formula = (v == 5) & F.lit(label is None and row == 4)
        cells.append(F.when(~fault, _cell(row, column, text, name=name, kind=kind, formula=formula, visible=v != 6)))
    for row in (head + 1, head + 2):
        cells += [F.when(~((v == 7) & F.lit(row == head + 1)) & ~((v == 8) & F.lit(c == last)), _cell(row, c, "1", name=name, visible=v != 6)) for c in "ABCDEFGH"[:width]]
    cells += [F.when(v == 9, _cell(3, "E", "x", name=name)), F.when(v == 10, _cell(head + 1, "I", "x", name=name)), F.when(v == 11, merge("B2:C2"))]
    title = f"A1:{last}1"
    cells += [F.when(v != 12, merge(title))]
    if layout == "recent":
        cells += [F.when(~((v == 13) & F.lit(row == head + 2)), merge(f"C{row}:F{row}")) for row in (head + 1, head + 2)]
        cells += [F.when(v == 14, _cell(8, "E", "x", name=name))]
    # a second sheet: the same once more, or another one
    again = [c for row, column, label in layouts.PLACES[layout] for c in [_cell(row, column, label or "x", sheet=1)]] + [_cell(row, c, "1", sheet=1) for row in (head + 1,) for c in "ABCDEFGH"[:width]] + [_cell(None, None, title, sheet=1, kind="merge")]
    again += [_cell(None, None, f"C{head + 1}:F{head + 1}", sheet=1, kind="merge")] if layout == "recent" else []
    cells += [F.when(v == 15, c) for c in again] + [F.when(v == 16, _cell(1, "A", "hoja", sheet=1, name="otra"))]
    return _spread(rows, "o_orderkey", cells)


_ALIKE = """WHEN 1 THEN {other} WHEN 2 THEN {none} WHEN 3 THEN {none} WHEN 4 THEN {kind} WHEN 5 THEN {formula} WHEN 6 THEN {none} WHEN 7 THEN 'unexpected_empty_row' WHEN 8 THEN {narrow} WHEN 9 THEN {extra} WHEN 10 THEN {none} WHEN 11 THEN {none} WHEN 12 THEN {none} WHEN 13 THEN {other} WHEN 14 THEN {other} WHEN 15 THEN 'ambiguous_statement_worksheets' WHEN 16 THEN {two}"""


def _sql(layout: str, **codes: str) -> str:
    none = f"'{layouts.SHAPES[layout][3]}'"
    cases = _ALIKE.format(**{k: v.replace("NONE", none) for k, v in {"none": "NONE", **codes}.items()})
    return f"""SELECT '{layout}' AS layout, o_orderkey AS source_id, CASE o_orderkey % 17 {cases} END AS code FROM orders"""


@query(f"""SELECT *, CASE WHEN code IS NULL THEN 0 END AS sheet_ordinal FROM ({_sql('cartola', other='NULL', kind="'cell_type_unsupported'", formula="'formula_unsupported'", narrow='NULL', extra='NONE', two="'worksheet_count_unsupported'")}
  UNION ALL {_sql('recent', other='NONE', kind='NULL', formula='NULL', narrow='NULL', extra='NULL', two='NULL')})""")
def layout_contracts(spark, sf_dir):
    """Orders as workbooks of two layouts, each with one way to miss its contract."""
    found = [layouts.match(_sheets(spark, sf_dir, n), n).select(F.lit(n).alias("layout"), "source_id", "code", "sheet_ordinal") for n in layouts.PLACES]
    return found[0].unionByName(found[1])


@query("""SELECT source_id, code, CASE WHEN code IS NULL THEN CAST(v = 7 AS INTEGER) END AS sheet_ordinal, CASE WHEN code IS NULL THEN 6 END AS header_row, CASE WHEN code IS NULL THEN d END AS period_start, CASE WHEN code IS NULL THEN d + 30 END AS period_end,
  CASE WHEN code IS NULL AND v <> 11 THEN CAST(1500 AS DECIMAL(20,2)) END AS opening_balance, CASE WHEN code IS NULL THEN CAST(CASE v WHEN 12 THEN 8.5 ELSE 0 END AS DECIMAL(20,2)) END AS ending_balance
  FROM (SELECT o_orderkey AS source_id, o_orderkey % 14 AS v, CAST(o_orderdate AS DATE) AS d, CASE o_orderkey % 14 WHEN 1 THEN 'movement_header_not_found' WHEN 2 THEN 'ambiguous_statement_worksheets' WHEN 3 THEN 'formula_unsupported' WHEN 4 THEN 'period_context_missing' WHEN 5 THEN 'period_context_ambiguous'
    WHEN 6 THEN 'period_context_invalid' WHEN 8 THEN 'movement_header_not_found' WHEN 9 THEN 'movement_header_not_found' WHEN 10 THEN 'period_context_missing' END AS code FROM orders)""")
def sheet_discovery(spark, sf_dir):
    """Orders as current accounts' workbooks: which sheet, which header, which period and balances."""
    k = F.col("o_orderkey")
    v, d = k % 14, F.col("o_orderdate").cast("date")
    rows = table(spark, sf_dir, "orders")
    header = lambda sheet, shown=True: [_cell(6, c, t, sheet=sheet, visible=shown) for c, t in zip("ACEFG", ["Fecha", "Descripción", "Cargos (CLP)", "ABONOS", "Saldo"], strict=True)]
    cells = [
        *(F.when((v != 1) & (v != 7) & (v != 9), c) for c in header(0)), *(F.when(v == 9, c) for c in header(0, False)), *(F.when(v.isin(2, 7), c) for c in header(1)), F.when(v == 8, _cell(6, "H", "Otra")),
        F.when(v == 1, _cell(6, "A", "Fecha")),
    ]
    for sheet in (0, 1):
        mine = (v == 7) if sheet else (v != 7)
        start, end = F.date_format(d, "dd/MM/yyyy"), F.date_format(F.date_add(d, 30), "yyyy-MM-dd")
        own = [
            F.when(v != 4, _cell(2, "B", "Désde:", sheet=sheet)), _cell(2, "C", "sin fecha", sheet=sheet, formula=v == 3), F.when(v != 10, _cell(2, "E", start, sheet=sheet)), F.when(v == 5, _cell(3, "A", "Start", sheet=sheet)), F.when(v == 5, _cell(3, "B", start, sheet=sheet)),
            _cell(4, "D", "hasta", sheet=sheet), _cell(4, "F", F.when(v == 6, F.date_format(F.date_sub(d, 1), "yyyy-MM-dd")).otherwise(end), sheet=sheet, kind=F.when(v == 13, "date").otherwise("text")),
            _cell(5, F.when(v == 11, "B").otherwise("A"), "Saldo inicial", sheet=sheet), _cell(5, "C", "?", sheet=sheet), _cell(5, "D", "1.500", sheet=sheet),
            _cell(1, "A", "Ending balance", sheet=sheet), _cell(1, "B", F.when(v == 12, "8.5").otherwise("0"), sheet=sheet, kind="n"), _cell(7, "A", "desde", sheet=sheet), _cell(7, "B", start, sheet=sheet),
        ]
        cells += [F.when(mine, c) for c in own]
    return layouts.discover_current(_spread(rows, "o_orderkey", cells)).select("source_id", "code", "sheet_ordinal", "header_row", "period_start", "period_end", "opening_balance", "ending_balance")
