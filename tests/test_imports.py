import json

from pyspark.sql import functions as F

from quillon.operators import imports
from quillon.plans import imports as plans  # noqa: F401
from quillon.plans.catalogue import QUERIES


def test_a_job_is_there_as_a_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.range(5).withColumnRenamed("id", "attempt_id")
    assert imports.commit({"batches": rows, "movements": rows.filter("attempt_id < 2")}, root, "a1")
    rows.write.parquet(f"{root}/batches/job=b2")  # broke off: no marker
    read = lambda name: sorted((r.job, r.attempt_id) for r in imports.committed(spark, root, name).collect())
    assert read("batches") == [("a1", n) for n in range(5)] and len(read("movements")) == 2
    assert not imports.commit({"batches": rows.limit(1)}, root, "a1")
    assert imports.commit({"batches": rows.filter("attempt_id = 4"), "movements": rows.filter("false")}, root, "b2")
    assert read("batches") == [("a1", n) for n in range(5)] + [("b2", 4)] and len(read("movements")) == 2


def test_cells_keep_their_exact_values(spark):
    cell = lambda k, c, t, v: (k, c, t, v, None, None, False, False)
    rows = [cell(1, "B", "float", "0.1"), cell(1, "A", "null", None), cell(1, "AA", "decimal", "1.50"), cell(1, "C", "datetime", "2024-01-02 03:04:05.6"), cell(2, "A", "float", "NaN"), cell(3, "a", "string", "x"), cell(4, "A", "string", "x\x00"), cell(5, "A", "integer", "1.0")]
    df = spark.createDataFrame(rows, "k int, column string, type string, value string, cell_type string, number_format string, is_date boolean, is_formula boolean")
    found = {r.k: r for r in imports.raw_cells(df, "k").collect()}
    cells = json.loads(found[1].raw_cells)["cells"]
    assert [(c["column"], c["value"]) for c in cells] == [("A", {"type": "null"}), ("B", {"type": "float", "hex": (0.1).hex()}), ("C", {"type": "datetime", "text": "2024-01-02T03:04:05.600000"}), ("AA", {"type": "decimal", "text": "1.50"})]
    assert cells[0]["cell_type"] is None
    assert {found[k].code for k in (2, 3, 4, 5)} == {"raw_record_serialization_invalid"} and imports.raw_cells(df.filter("false"), "k").count() == 0


def test_sheets_of_another_variant(spark):
    good = ["metadata_row", "header_row", "", "blank_row", "commission_summary_section", "commission_summary", "post_summary_section", "auxiliary_row"]
    sheets = {
        None: good, "header_not_unique": ["metadata_row", ""], "sections_unpaired": [*good[:6], "blank_row"], "outside_section": ["header_row", "commission_summary"],
        "inside_section": [*good[:5], "blank_row", *good[6:]], "after_section": [*good, "blank_row"], "auxiliary_above_movements": ["header_row", "auxiliary_row", ""],
    }
    rows = [(k or "good", n, "IGNORED" if c else "PARSED", [c] if c else [], False) for k, codes in sheets.items() for n, c in enumerate(codes, 1)] + [("beyond_table", 1, "IGNORED", ["header_row"], True)]
    found = imports.sheet_structure(spark.createDataFrame(rows, "source_id string, row_number int, outcome string, codes array<string>, beyond boolean"))
    assert {(r.source_id, r.fault) for r in found.collect()} == {(k, k) for k in [*sheets, "beyond_table"] if k}


def test_totals_are_those_of_the_tables(spark, sf_dir):
    decided = [(1, "XLSX", "ACCEPTED"), (2, "HISTORICAL_PDF", "PARTIAL"), (3, "XLSX", "FATAL"), (4, "CARD_PDF", "REJECTED"), (5, "XLSX", "ACCEPTED"), (6, None, "ACCEPTED")]
    rows = [(k, n, o, a) for k in (1, 2, 3, 4, 6, 7) for n, (o, a) in enumerate((("PARSED", "1.25"), ("PARSED", None), ("REJECTED", "9"), (None, "7")), 1) if k != 4 or o != "PARSED"]
    attempts = spark.createDataFrame([(k, k, "d", kind, k, status) for k, kind, status in decided], "attempt_id long, account_id long, digest string, source_kind string, completed_at long, status string")
    lines = spark.createDataFrame(rows, "attempt_id long, row_number int, outcome string, signed_amount string").selectExpr("attempt_id", "row_number", "outcome", "array('c') AS codes", "DATE '2024-01-01' AS date", "'x' AS description", "CAST(signed_amount AS DECIMAL(20,2)) AS signed_amount")
    tables = imports.ledger(attempts, lines)
    want = {(r.attempt_id, name, r.n, r.total) for name, total in (("raw_records", "max(0)"), ("movements", "sum(signed_amount)"), ("observations", "sum(signed_amount)")) for r in tables[name].groupBy("attempt_id").agg(F.count("*").alias("n"), F.expr(total).alias("total")).collect()}
    assert {(r.attempt_id, r.table_name, r.n, r.total) for r in imports.ledger_totals(attempts, lines).collect()} == want
    # rows meet the attempts summed up: once for these sums, once for the counts that decide
    plan = QUERIES["import_ledger"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 2
