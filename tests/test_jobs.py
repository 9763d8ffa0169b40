"""Import jobs from files, and the log of snapshots that they commit to."""

import datetime
import json
import threading

from test_sources import workbook

from quillon.operators import snapshots
from quillon.sources import historical
from quillon.streaming import jobs

HEAD = {1: {"A": "desde", "B": "01/01/2026"}, 2: {"A": "hasta", "B": "31/01/2026"}, 3: {"A": "Saldo inicial", "B": "100"}, 4: {"A": "Saldo final", "B": "70"}, 5: {"A": "Fecha", "C": "Detalle", "E": "Cargos", "F": "Abonos", "G": "Saldo"}}
GOOD = HEAD | {6: {"A": "05/01", "C": "a", "E": "50"}, 7: {"A": "06/01", "C": "b", "F": "20"}}
PARTIAL = HEAD | {6: {"A": "05/01", "C": "a", "E": "50"}, 7: {"A": "06/01", "C": "b", "E": "1", "F": "20"}}


def printed(rows, closing="950", currency="Pesos"):
    out, width = [], {"date": 45, "description": 160, "debit": 365, "credit": 440, "balance": 510}

    def put(y, *texts):
        out.extend({"page": 1, "ordinal": len(out) + k, "text": t, "x0": x, "y0": y, "x1": x + 5.0, "y1": y + 6.0} for k, (x, t) in enumerate(texts))

    put(10.0, (50, "BCI"), (80, "Cartola"), (120, "Cuenta"), (160, "Corriente"))
    put(20.0, (50, "Cartola"), (540, "12"))
    put(30.0, (50, "Cuenta"), (450, "77"), (520, "Moneda"), (560, currency))
    put(40.0, (50, "Periodo"), (100, "01-01-2026"), (180, "31-01-2026"))
    put(80.0, *((x, w) for w, x in historical.HEADER.items()), (560, "diario"))
    for n, row in enumerate(rows):
        put(100.0 + 10 * n, *((width[k], v) for k, v in row.items()))
    put(300.0, (50, "Resumen"), (100, "periodo"))
    put(310.0, (50, "01-01-2026"), (100, "-"), (110, "31-01-2026"), (285, "Saldo"), (320, "anterior"), (355, "Total"), (385, "cargos"), (430, "Total"), (460, "abonos"), (540, "Saldo"), (570, "contable"))
    put(330.0, (300, "1.000"), (390, "50"), (470, "0"), (560, closing))
    return json.dumps(out).encode()


ROWS = [{"date": "05/01/2026", "description": "uno", "debit": "50", "balance": "950"}]


def place(folder, kind, account, name, content):
    path = folder / kind / account
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_bytes(content)


def accounts(spark):
    return spark.createDataFrame([("a1", "CURRENT", "ASSET", "CLP"), ("a2", "CURRENT", "ASSET", "CLP"), ("c1", "CREDIT_CARD", "LIABILITY", "CLP")], "account_id string, kind string, economic_orientation string, currency string")


def test_files_to_tables_and_again(spark, tmp_path):
    folder, root, state = tmp_path / "in", str(tmp_path / "ledger"), str(tmp_path / "state")
    good, nul = workbook(GOOD), b"not a package"
    place(folder, "XLSX", "a1", "1-good.xlsx", good)
    place(folder, "XLSX", "a1", "2-twin.xlsx", good)
    place(folder, "XLSX", "a2", "3-partial.xlsx", workbook(PARTIAL))
    place(folder, "XLSX", "a1", "4-bad.xlsx", nul)
    place(folder, "XLSX", "a1", "5-plain.xlsx", workbook({1: {"A": "x"}}))
    place(folder, "XLSX", "a1", "6-empty.xlsx", workbook({}))
    place(folder, "XLSX", "a1", "7-period.xlsx", workbook(GOOD | {1: {"A": "desde", "B": "=TODAY()"}}))
    place(folder, "XLSX", "a1", "8-shape.xlsx", workbook(GOOD | {8: {"C": "Resumen de comisiones"}}))
    place(folder, "XLSX", "c1", "9-card.xlsx", good)
    place(folder, "HISTORICAL_PDF", "a1", "a-printed.json", printed(ROWS))
    place(folder, "HISTORICAL_PDF", "a1", "b-money.json", printed(ROWS, currency="USD"))
    place(folder, "HISTORICAL_PDF", "a1", "c-none.json", b"[]")
    jobs.run(jobs.stream(spark, str(folder)), accounts(spark), root, state).awaitTermination(300)
    ledger = snapshots.Ledger(spark, root)
    assert ledger.version() == 1

    def batches():
        return {r["filename"]: r for r in ledger.table("batches", ledger.version(), jobs.BATCHES).collect()}

    found = batches()
    assert {k: (r["status"], r["failure_stage"], r["failure_code"]) for k, r in found.items()} == {
        "3-partial.xlsx": ("PARTIAL", None, None), "4-bad.xlsx": ("FATAL", "PARSER", "xlsx_invalid"), "5-plain.xlsx": ("FATAL", "PARSER", "movement_header_not_found"), "6-empty.xlsx": ("FATAL", "PARSER", "movement_header_not_found"),
        "7-period.xlsx": ("FATAL", "PARSER", "formula_unsupported"), "8-shape.xlsx": ("FATAL", "BOUNDARY", "boundary_validation_failed"), "9-card.xlsx": ("FATAL", "REGISTRATION", "account_kind_unsupported"),
        "a-printed.json": ("ACCEPTED", None, None), "b-money.json": ("FATAL", "PARSER", "currency_missing"), "c-none.json": ("FATAL", "PARSER", "native_text_required"),
    } | {k: (found[k]["status"], None, None) for k in ("1-good.xlsx", "2-twin.xlsx")}
    twins = [found["1-good.xlsx"], found["2-twin.xlsx"]]
    assert sorted(r["status"] for r in twins) == ["ACCEPTED", "DUPLICATE"]
    one = next(r for r in twins if r["status"] == "ACCEPTED")
    assert (one["parsed"], one["ignored"], one["rejected"], one["reconciliation_status"], one["period_start"]) == (2, 5, 0, "RECONCILED", datetime.date(2026, 1, 1))
    table = lambda name, kind: ledger.table(name, ledger.version(), kind)
    assert sorted((r["account_id"], int(r["signed_amount"])) for r in table("movements", jobs.MOVEMENTS).collect()) == [("a1", -50), ("a1", 20), ("a2", -50)]
    assert [(r["state"], int(r["signed_amount"])) for r in table("observations", jobs.MOVEMENTS + ", state string").collect()] == [("UNRESOLVED", -50)]
    assert table("artifacts", jobs.ARTIFACTS).count() == 10
    # nothing new: nothing happens
    jobs.run(jobs.stream(spark, str(folder)), accounts(spark), root, state).awaitTermination(300)
    assert ledger.version() == 1
    # a copy of a known file, and a new one
    place(folder, "XLSX", "a1", "d-copy.xlsx", good)
    place(folder, "XLSX", "a2", "e-good.xlsx", good)
    jobs.run(jobs.stream(spark, str(folder)), accounts(spark), root, state).awaitTermination(300)
    found = batches()
    assert (found["d-copy.xlsx"]["status"], found["d-copy.xlsx"]["duplicate_of"]) == ("DUPLICATE", one["attempt_id"]) and found["e-good.xlsx"]["status"] == "ACCEPTED"
    assert table("artifacts", jobs.ARTIFACTS).count() == 10 and ledger.table("movements", 1, jobs.MOVEMENTS).count() == 3


def test_of_two_jobs_the_second_decides_anew(spark, tmp_path):
    root, good = str(tmp_path / "ledger"), workbook(GOOD)
    kind = "path string, content binary, source_kind string, account_id string, filename string"
    files = [spark.createDataFrame([(f"/{n}", good, "XLSX", "a1", f"{n}.xlsx")], kind) for n in "xy"]
    versions, first = [], snapshots.Ledger(spark, root)

    def one(n, name):
        versions.append(jobs.job(files[n], accounts(spark), snapshots.Ledger(spark, root), name))

    threads = [threading.Thread(target=one, args=(n, name)) for n, name in ((0, "same"), (0, "same"), (1, "other"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    # one of the two of one name has added nothing
    assert sorted(v or 0 for v in versions) == [0, 1, 2] and first.version() == 2
    rows = first.table("batches", 2, jobs.BATCHES).collect()
    assert sorted(r["status"] for r in rows) == ["ACCEPTED", "DUPLICATE"]
    assert first.table("artifacts", 2, jobs.ARTIFACTS).count() == 1 and first.table("movements", 2, jobs.MOVEMENTS).count() == 2


def test_a_manifest_is_made_once(spark, tmp_path):
    ledger = snapshots.Ledger(spark, str(tmp_path / "log"))
    made = []
    threads = [threading.Thread(target=lambda k=k: made.append(ledger._create(1, json.dumps({"version": 1, "job": str(k)})))) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert made.count(True) == 1 and ledger.version() == 1 and ledger.manifests(1).count() == 1


def test_artifacts_are_compared_by_their_bytes(spark):
    kind = "digest string, content binary, filename string"
    held = spark.createDataFrame([("d1", b"one", "a")], kind)
    rows = spark.createDataFrame([("d1", b"one", "b"), ("d1", b"two", "c"), ("d2", b"x", "d"), ("d2", b"x", "e"), ("d2", b"y", "f"), ("d3", b"", "g"), ("d3", b"", "g")], kind)
    found = sorted((r["filename"], r["outcome"]) for r in snapshots.register(rows, held).collect())
    assert found == [("b", "GOT"), ("c", "content_digest_collision"), ("d", "NEW"), ("e", "GOT"), ("f", "content_digest_collision"), ("g", "GOT"), ("g", "NEW")]
