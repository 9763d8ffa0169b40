import datetime
import io
import zipfile

from pyspark.sql import functions as F

from quillon.operators import lifecycle, reconcile
from quillon.plans import layouts as layout_plans
from quillon.sources import cells, historical, layouts, statements, tokens
from quillon.streaming import ingest

D = datetime.date


def workbook(rows, extra=()):
    out = io.BytesIO()
    body = "".join(f'<row r="{r}">' + "".join(f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if not v.startswith("=") else f'<c r="{c}{r}"><f>{v[1:]}</f><v>1</v></c>' for c, v in row.items()) + "</row>" for r, row in rows.items())
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="u"><sheets><sheet name="m" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet><dimension ref="A1:A1"/><sheetData>{body}</sheetData></worksheet>')
        for name, data in extra:
            z.writestr(name, data)
    return out.getvalue()


def test_workbooks_to_movements(spark):
    good = workbook({1: {"A": "t"}, 8: {"A": "Fecha"}, 9: {"A": "05/01/2026", "B": "05/01/2026", "C": "x", "G": "1.234"}, 10: {"A": "06/01/2026", "B": "06/01/2026", "C": "late", "H": "5"}, 11: {"A": "01/01/2026", "B": "99/01/2026", "C": "y", "G": "1", "H": "2"}, 12: {"A": "01/01/2026", "B": "01/01/2026", "C": "=f()", "H": "7"}})
    files = spark.createDataFrame([("good", good), ("bad", b"no zip"), ("wide", workbook({1: {"ZZ": "x"}})), ("macro", workbook({}, [("xl/vbaProject.bin", b"")])), ("many", workbook({}, [(f"n{k}", b"") for k in range(130)]))], "path string, content binary")
    found = cells.xlsx_cells(files).cache()
    assert {r["source_id"]: r["code"] for r in found.filter("code is not null").collect()} == {"bad": "package_invalid", "wide": "sheet_extent_exceeded", "macro": "package_content_refused", "many": "package_entries_exceeded"}
    rows = {r["row_number"]: r for r in statements.recent(cells.wide(found)).collect()}
    assert [(k, rows[k]["outcome"], list(rows[k]["codes"])) for k in sorted(rows)] == [
        (1, "IGNORED", ["metadata_row"]), (8, "IGNORED", ["header_row"]), (9, "PARSED", []), (10, "REJECTED", ["transaction_date_order_invalid"]),
        (11, "REJECTED", ["accounting_date_invalid", "direction_xor_invalid"]), (12, "REJECTED", ["formula_unsupported"]),
    ]


def test_current_account(spark):
    sheet = [
        (1, "Cuenta", None, None, None, None, None, None, False), (2, "Fecha", None, "Detalle", None, "Cargos", "Abonos", "Saldo", False), (3, "31/12", None, "a", None, "1.000", None, "9.000", False), (4, "02/01/2026", None, "b", None, None, "500", "x", False),
        (5, None, None, None, None, None, None, None, False), (6, "03/01", None, "c", None, "1", "2", None, False), (7, "30/02", None, "d", None, "1", None, None, False), (8, "04/01", None, "e", None, None, None, None, False),
        (9, None, None, "more", None, None, None, None, False), (10, "05/01", None, "f", None, "9", None, None, True), (11, "Fecha", None, "Detalle", None, "Cargos", "Abonos", "Saldo", False), (12, None, None, "Resumen de comisiones", None, None, None, None, False), (13, "06/01", None, "g", None, "5", None, None, False), (14, "Mensajes", None, None, None, None, None, None, False), (15, "07/01", None, "h", None, "5", None, None, False),
    ]
    rows = spark.createDataFrame([("s", 0, *r, False) for r in sheet], "source_id string, sheet_ordinal int, row_number int, A string, B string, C string, D string, E string, F string, G string, has_formula boolean, has_other_type boolean")
    periods = spark.createDataFrame([("s", D(2025, 12, 20), D(2026, 1, 20))], "source_id string, period_start date, period_end date")
    found = {r["row_number"]: r for r in statements.current(rows, periods).collect()}
    assert [(k, found[k]["outcome"][0], *found[k]["codes"]) for k in sorted(found)] == [
        (1, "I", "metadata_row"), (2, "I", "header_row"), (3, "P"), (4, "P", "running_balance_invalid"), (5, "I", "blank_row"), (6, "R", "debit_credit_conflict"), (7, "R", "date_invalid"), (8, "R", "amount_missing"),
        (9, "I", "auxiliary_row"), (10, "R", "formula_unsupported"), (11, "I", "repeated_header"), (12, "I", "commission_summary_section"), (13, "I", "commission_summary"), (14, "I", "post_summary_section"), (15, "I", "auxiliary_row"),
    ]
    assert (found[3]["date"], int(found[3]["signed_amount"]), int(found[4]["signed_amount"])) == (D(2025, 12, 31), -1000, 500)


def test_printed_statement(spark):
    def line(y, **texts):
        return [(text, tokens.BANDS[band][0] + 1.0, float(y), tokens.BANDS[band][1] - 1.0, y + 8.0) for band, text in texts.items()]

    def said(y, *texts):
        return [(text, float(x), float(y), x + 5.0, y + 8.0) for x, text in texts]

    head = [*said(10, (50, "BCI Cartola Cuenta Corriente")), *said(20, (50, "Cartola"), (540, "12")), *said(30, (50, "Cuenta"), (450, "77"), (520, "Moneda CLP"), (560, "Pesos")), *said(40, (50, "Período 01-01-2026 al 31-01-2026")), *said(80, *((x, w) for w, x in historical.HEADER.items()), (560, "diario"))]
    rows = [*line(100, date="05/01/2026", description="first", debit="100", balance="900"), *line(110.5, description="goes on"), *line(120, date="04/01/2026", description="early", credit="5", balance="905"), *line(130, date="06/01/2026", description="both", debit="1", credit="2", balance="9"), *line(140, date="07/01/2026", description="Pago", credit="50", balance="950")]
    foot = [*said(150, (20, "Notas"), (160, "pie")), *line(160, description="de pagina"), *said(300, (50, "Resumen del período")), *said(310, (50, "01-01-2026 - 31-01-2026"), (300, "Saldo anterior"), (310, "1.000"), (540, "Saldo contable")), *said(330, (560, "950"))]
    frame = spark.createDataFrame([("d", 1, k, *t) for k, t in enumerate([*head, *rows, *foot])], "doc_id string, page int, ordinal int, text string, x0 double, y0 double, x1 double, y1 double")
    docs, printed = historical.documents(tokens.lines(frame))
    doc = docs.first()
    assert (doc["code"], doc["statement_id"], doc["source_account_id"], doc["opening"], doc["debits"], doc["closing"]) == (None, "12", "77", 1000, None, 950)
    found = statements.historical(printed, docs.select("doc_id", "period_start", "period_end")).orderBy("row").collect()
    assert [(r["description"], r["outcome"], list(r["codes"])) for r in found] == [("first goes on", "PARSED", []), ("early", "REJECTED", ["date_order_invalid"]), ("both", "REJECTED", ["amount_both_sides"]), ("Pago", "PARSED", [])]
    assert [int(r["signed_amount"]) for r in found if r["outcome"] == "PARSED"] == [-100, 50]


def test_statement_checks(spark):
    rows = spark.createDataFrame([("b", 1, 100, None, 900), ("b", 2, None, 50, 950), ("c", 1, 10, None, 80)], "import_batch_id string, ordinal int, debit int, credit int, balance int").selectExpr("import_batch_id", "ordinal", "'PARSED' outcome", *(f"cast({c} as decimal(20,2)) {c}" for c in ("debit", "credit", "balance")))
    batches = spark.createDataFrame([("b", 1000, 950, 100, 50), ("c", 100, 80, 20, 0), ("d", 5, 6, 0, 1)], "import_batch_id string, opening int, closing int, debits int, credits int").selectExpr("import_batch_id", *(f"cast({c} as decimal(20,2)) {c}" for c in ("opening", "closing", "debits", "credits")))
    found = {r["import_batch_id"]: r.asDict() for r in reconcile.historical_checks(rows, batches).collect()}
    assert [found[k]["difference"] and int(found[k]["difference"]) for k in "bcd"] == [None, 10, -1]
    assert [found["c"][n] for n in reconcile.CHECKS] == ["FAIL", "PASS", "FAIL", "PASS"] and [found["d"][n] for n in reconcile.CHECKS] == ["INSUFFICIENT_DATA", "PASS", "FAIL", "FAIL"]
    assert found["d"]["running_balance_continuity_reason"] == "no_transaction_balance" and found["b"]["reconciliation_status"] == "RECONCILED"
    lines = spark.createDataFrame([("x", "previous", 1, 100), ("x", "purchases", 2, 50), ("x", "charges", 3, 5), ("x", "charges", 4, 7), ("x", "payments", 5, -100), ("x", "current", 6, 55), ("y", "previous", 1, 3)], "import_batch_id string, operand string, line int, value int")
    cards = {r["import_batch_id"]: r for r in reconcile.card_equation(lines).collect()}
    assert cards["x"]["reconciliation_status"] == "RECONCILED" and cards["y"]["missing"] == ["purchases", "charges", "payments", "current"]


def test_blocks_say_what_one_window_says(spark):
    import random

    rng = random.Random(4)
    data = [(rng.choice(["hot", "hot", "hot", "cold", None]), k, rng.choice([None, *range(-5, 6)]), rng.choice([None, 0, 7]), D(2026, 1, rng.randint(1, 28)) if k % 9 else None) for k in range(300)]
    rows = spark.createDataFrame(data, "a string, k int, v int, b int, date date").selectExpr("a", "k", "cast(v as decimal(20,2)) signed_amount", "cast(b as decimal(20,2)) balance", "date")
    zero, valid, block = F.lit(0).cast("decimal(20,2)"), F.col("k") % 5 != 0, F.floor(F.col("k") / 7)
    every = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for found in (
        lambda block=None: reconcile.running_balance(rows, "a", ["k"], block),
        lambda block=None: reconcile.continuity(rows, zero, "a", ["k"], block),
        lambda block=None: reconcile.date_order(rows, "a", ["k"], valid, True, block),
        lambda block=None: reconcile.date_order(rows, "a", ["k"], valid, False, block),
    ):
        whole = every(found())
        assert len(whole) > 2 and every(found(block)) == whole
    total, got = {}, {r["k"]: r["running_balance"] for r in reconcile.running_balance(rows, "a", ["k"], block).collect()}
    for a, k, v, _, _ in data:
        total[a] = total.get(a) if v is None else (total.get(a) or 0) + v
        assert got[k] == total[a]
    assert reconcile.running_balance(rows.filter("k < 0"), "a", ["k"], block).isEmpty()


def test_continuity_reads_its_rows_once(spark, capsys):
    rows = spark.createDataFrame([("a", 1, 1, 1), ("a", 2, 1, 3), ("a", 9, 1, 5), ("b", 1, 1, 2), ("c", 1, 1, 1), ("c", 8, 1, None), ("c", 16, 1, 3)], "a string, k int, v int, b int").selectExpr("a", "k", "cast(v as decimal(20,2)) signed_amount", "cast(b as decimal(20,2)) balance")
    for block in (None, F.floor(F.col("k") / 7)):
        found = reconcile.continuity(rows, F.lit(0).cast("decimal(20,2)"), "a", ["k"], block)
        found.explain()
        assert capsys.readouterr().out.count("Scan ") == 1
        # what follows a balance that isn't there goes on from the opening
        assert sorted((r["a"], r["row"], int(r["difference"])) for r in found.collect()) == [("a", 2, -1), ("b", 1, -1), ("c", 3, -2)]


def test_policy_against_a_fold(spark):
    import random

    rng = random.Random(9)
    claims = [(f"o{k}", "a", D(2026, 1, rng.randint(1, 3)), rng.randint(1, 3), "CLP", rng.randint(1, 3), k) for k in range(60)]
    ledger = [("a", D(2026, 1, 1), 2, "CLP")]
    held, want = {t: "ledger" for t in ledger}, {}
    for o, *t, batch, _ in sorted(claims, key=lambda c: (c[5], c[6])):
        owner = held.setdefault(tuple(t), batch)
        first = not any(w == "reconciled_historical_new" and x == tuple(t) for x, w in want.values())
        want[o] = (tuple(t), None if owner != batch else "reconciled_historical_new" if first else "same_statement_distinct_ordered_row")
    names = "account_id string, date date, amount int, currency string"
    got = lifecycle.confirm(spark.createDataFrame(claims, f"observation_id string, {names}, batch_order int, ordinal int"), spark.createDataFrame(ledger, names)).collect()
    assert {r["observation_id"]: r["reason"] for r in got} == {o: w for o, (_, w) in want.items()}


def test_streaming_ingestion(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    ledger, state = str(tmp_path / "ledger"), str(tmp_path / "state")
    for step in (["a", "b", "a"], ["b", "c"]):
        for k, data in enumerate(step):
            (folder / f"{len(list(folder.iterdir()))}-{k}.pdf").write_bytes(data.encode())
        ingest.ingest(ingest.files(spark, str(folder), "acc"), ledger, state).awaitTermination(60)
    rows = spark.read.parquet(ledger).collect()
    assert len(rows) == 3 and len({r["digest"] for r in rows}) == 3
    assert spark.read.parquet(ledger).agg(F.max("copies")).first()[0] == 2


def test_workbooks_beyond_the_limits_are_refused(monkeypatch):
    def code(content):
        try:
            return len(list(cells.sheet_cells(content)))
        except cells.Refused as e:
            return str(e)

    deep = "<a>" * 70 + "</a>" * 70
    assert code(workbook({1: {"A": "x"}})) == 1
    assert code(workbook({1: {"A": deep}})) == "xml_structure_exceeded"
    assert code(workbook({1: {"A": f"<{'n' * 2000}/>"}})) == "xml_structure_exceeded"
    assert code(workbook({9000: {"A": "x"}, 1: {"AZ": "x"}})) == "sheet_extent_exceeded"  # few cells, a large rectangle
    assert code(workbook({1: {"A": '<Relationship TargetMode="External"/>'}})) == "package_content_refused"
    monkeypatch.setitem(cells.LIMITS, "elements", 12)
    assert code(workbook({n: {"A": "x"} for n in range(1, 9)})) == "xml_structure_exceeded"
    monkeypatch.undo()
    out = io.BytesIO(workbook({}, [("xl/sharedStrings.xml", f"<sst><si><t>{'s' * 900}</t></si></sst>")]))
    sheet = "<worksheet>" + "".join(f'<c r="A{n}" t="s"><v>0</v></c>' for n in range(1, 8)) + "</worksheet>"
    with zipfile.ZipFile(out) as old, zipfile.ZipFile(again := io.BytesIO(), "w") as new:
        for name in old.namelist():
            new.writestr(name, sheet if name.endswith("s.xml") and "sheets/" in name else old.read(name))
    assert code(again.getvalue()) == 7
    monkeypatch.setitem(cells.LIMITS, "total", 5000)
    assert code(again.getvalue()) == "shared_strings_exceeded"


def test_discovery_reads_cells_once(spark, sf_dir):
    """What is found comes from the rows that are held; the cells aren't read again for it."""
    found = layout_plans.sheet_discovery(spark, sf_dir)
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()


def test_contracts_read_cells_once(spark, sf_dir):
    """A layout is tested in one pass over the cells."""
    found = layouts.match(layout_plans._sheets(spark, sf_dir, "recent"), "recent")
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_historical_lines_are_dealt_once(spark):
    """Lines, pages and documents share an exchange, and a line doesn't carry its page's header."""
    tokens_ = spark.createDataFrame([("a", 1, 0, "x", 1.0, 2.0, 3.0, 4.0)], "doc_id string, page int, ordinal int, text string, x0 double, x1 double, y0 double, y1 double")
    rows = historical._lines(tokens.lines(tokens_))
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert "t" not in rows.schema["h"].dataType.names
