"""Rules of the ledger on hand-made rows."""

import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from quillon.functions import money
from quillon.operators import constraints, evidence, lifecycle, report, validation
from quillon.plans import evidence as evidence_plans

DAY = datetime.date(2024, 5, 1)


def test_printed_amounts_are_never_rounded(spark):
    rows = spark.createDataFrame([("1.234",), ("1.005",), ("1,5",), ("(12)",), ("1.234,56",), ("9" * 19,)], "t string")
    t = money.token_amount(F.col("t"))
    found = [(r["v"], r["c"]) for r in rows.select(money.exact(t).alias("v"), money.exact_code(t).alias("c")).collect()]
    assert found == [(None, "money_scale_exceeded"), (None, "money_scale_exceeded"), (Decimal("1.50"), None), (Decimal("-12.00"), None), (Decimal("1234.56"), None), (None, "money_precision_exceeded")]


CLAIM = "observation_id long, raw_record_id long, account_id long, state string, state_version int, transaction_date date, accounting_date date, signed_amount decimal(20,2), currency string, description string, source_reference string, interpretation_method string, interpretation_version string, current_movement_id string"


def claim(k, raw=1, account=1, state="UNRESOLVED", version=0, text=None, movement=None):
    return k, raw, account, state, version, None, DAY, Decimal(1), "CLP", text or f"text {k}", None, "method", "v1", movement


def test_a_refused_command_uses_no_successor_up(spark):
    seen = spark.createDataFrame([claim(1, raw=9), claim(2), claim(3), claim(4, account=2), claim(5, text="text 2"), claim(6, movement="m"), claim(7, version=1), claim(8), claim(9)], CLAIM)
    commands = [(1, 3), (2, 3), (8, 3), (2, 2), (2, 4), (2, 5), (2, 6), (2, 7), (2, 77), (2, None), (2, 9)]
    found = evidence.supersede_guard(spark.createDataFrame(commands, "observation_id long, successor_id long"), seen, used=spark.createDataFrame([(9,)], "successor_id long"))
    assert {(r["observation_id"], r["successor_id"]): r["code"] for r in found.collect()} == {
        (1, 3): "successor_raw_record_mismatch", (2, 3): None, (8, 3): "successor_already_used", (2, 2): "successor_observation_same", (2, 4): "successor_account_mismatch", (2, 5): "successor_claim_unchanged",
        (2, 6): "successor_not_fresh", (2, 7): "successor_not_fresh", (2, 77): "successor_observation_not_found", (2, None): "successor_observation_missing", (2, 9): "successor_already_used",
    }


def test_attempts_of_all_routes_are_known(spark):
    rows = spark.createDataFrame([(1, "XLSX"), (2, "CARD_PDF"), (3, "HISTORICAL_PDF"), (4, "PDF")], "attempt_id long, source_kind string").select("*", F.lit("ACCEPTED").alias("status"), F.lit(None).cast("string").alias("failure_code"), F.lit(None).cast("long").alias("duplicate_of"), F.lit(DAY).alias("completed_at"))
    assert [tuple(r) for r in constraints.broken(rows, "attempt_id", **validation.attempt_rules()).collect()] == [("attempt_kind_known", "4")]


def test_names_of_categories(spark):
    rows = spark.createDataFrame([(1, "Café"), (2, "CAFÉ"), (3, "Cafe\u0301"), (4, None), (5, "x" * 81), (6, "a\tb"), (7, "fine")], "category_id long, display_name string")
    assert {r["key"] for r in constraints.broken(rows, "category_id", **validation.category_rules()).collect()} == {"3", "4", "5", "6"}
    assert {r["key"] for r in validation.category_repeats(rows).collect()} == {"1", "2"}


def test_evidence_of_a_claim(spark):
    one = spark.createDataFrame([claim(1)], CLAIM)
    records = spark.createDataFrame([(1, 7, "PARSED")], "raw_record_id long, import_batch_id long, parse_outcome string")
    batches = spark.createDataFrame([(7, "ACCEPTED", "RECONCILED")], "import_batch_id long, status string, reconciliation_status string")
    proof = lambda day: spark.createDataFrame([(1, day, DAY, Decimal(1), "CLP", None)], "raw_record_id long, transaction_date date, accounting_date date, signed_amount decimal(20,2), currency string, running_balance decimal(20,2)")
    said = lambda seen, day=None: evidence.eligible(seen, records, batches, proof(day)).first()["eligible"]
    assert said(one)
    assert not said(one, DAY)
    assert not said(one.withColumn("transaction_date", F.lit(DAY)))
    assert not said(one.withColumn("interpretation_method", F.lit("other")))
    assert not said(one.withColumn("interpretation_version", F.lit("v2")))


def test_rows_of_one_statement(spark):
    kind = "observation_id long, ordinal int, balance decimal(20,2), own_ordinal int, own_balance decimal(20,2), same_batch boolean"
    good = [(1, 2, Decimal(5), 4, Decimal(6), True), (1, 3, Decimal(5), 4, Decimal(6), True)]
    bad = [(2, 2, Decimal(5), 2, Decimal(6), True), (3, 2, None, 4, Decimal(6), True), (4, 2, Decimal(5), 4, Decimal(6), False), (5, 2, Decimal(5), None, Decimal(6), True), (6, 2, Decimal(5), 4, Decimal(6), True), (6, 2, Decimal(5), 4, Decimal(6), True)]
    found = evidence.same_statement(spark.createDataFrame(good + bad, kind)).collect()
    assert {r["observation_id"]: r["distinct_rows"] for r in found} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def test_json_rows_keep_scale_and_nulls(spark):
    rows = spark.createDataFrame([(1, Decimal("1.50"), DAY, None)], "id long, signed_amount decimal(20,2), occurrence_date date, reference string")
    assert report.as_json(rows).first()["json"] == '{"id":1,"signed_amount":"1.50","occurrence_date":"2024-05-01","reference":null}'


def test_replay_splits_a_hot_history(spark):
    rows = spark.createDataFrame([(7 if k % 3 else k % 5, k, ("CONFIRM_NEW", "MARK_CONFLICT", "REOPEN", "REJECT", "X", "MATCH_EXISTING")[k * k % 6]) for k in range(3000)], "o long, at long, action string")
    found = lifecycle.replay(rows.repartition(8), "o", ["at"]).collect()
    state, n, legal = {}, {}, {(a, f): t for a, f, t in lifecycle.TRANSITIONS}
    assert len(found) == 3000
    for r in sorted(found, key=lambda r: r["at"]):
        now = state.get(r["o"], "UNRESOLVED")
        to = legal.get((r["action"], now))
        n[r["o"]] = n.get(r["o"], 0) + bool(to)
        state[r["o"]] = to or now
        assert (r["from_state"], r["to_state"], r["sequence"], r["code"]) == (now, to or now, n[r["o"]] if to else None, None if to else "transition_invalid")
    assert lifecycle.replay(rows.limit(0), "o", ["at"]).count() == 0


def test_backfills_go_back_and_refuse(spark, sf_dir):
    import pytest

    from quillon.operators import backfill
    from quillon.plans import results

    older = results._older(spark, sf_dir)
    newer = backfill.forward(**older)
    again = backfill.back(**newer)
    for name, df in older.items():
        assert backfill.same(df, again[name].select(df.columns), *df.columns), name
    assert not backfill.same(older["records"], older["records"].limit(5), "raw_record_id")

    def refused(run, **changed):
        with pytest.raises(backfill.Refused) as e:
            run(**changed)
        return str(e.value)

    cut = lambda name, n=1: {**older, name: older[name].orderBy("raw_record_id").limit(n)}
    assert refused(backfill.forward, **{**older, "artifacts": older["artifacts"].withColumn("source_kind", F.lit("PDF"))}) == "source_kind_unknown"
    assert refused(backfill.forward, **{**older, "records": older["records"].withColumn("row_number", F.lit(0))}) == "row_number_invalid"
    assert refused(backfill.forward, **{**older, "movements": older["movements"].withColumn("amount_source_column", F.lit("G"))}) == "amount_column_unknown"
    assert refused(backfill.forward, **{**older, "records": older["records"].withColumn("parse_outcome", F.lit("IGNORED"))}) == "movement_of_unparsed"
    assert refused(backfill.forward, **cut("movements")) == "parsed_rows_and_movements_differ"
    assert refused(backfill.back, **{**newer, "batches": newer["batches"].withColumn("source_kind", F.lit("CARD_PDF"))}) == "source_kind_unknown"
    assert refused(backfill.back, **{**newer, "batches": newer["batches"].limit(1)}) == "artifact_without_batch"
    assert refused(backfill.back, **{**newer, "records": newer["records"].withColumn("record_kind", F.lit("OTHER"))}) == "record_kind_unknown"
    kinds = spark.createDataFrame([("CURRENT",), ("CREDIT_CARD",)], "kind string")
    assert [r["economic_orientation"] for r in backfill.orientations(kinds).collect()] == ["ASSET", "LIABILITY"]
    assert refused(backfill.orientations, accounts=kinds.withColumn("kind", F.lit("SAVINGS"))) == "account_kind_unknown"


def test_vocabularies_are_apart():
    import pytest

    words = validation.SHEET_VOCABULARY
    assert words["PARSED"] == {"running_balance_invalid"} and "header_row" in words["IGNORED"] and "amount_invalid" in words["REJECTED"]
    assert not words["PARSED"] & words["REJECTED"] and frozenset().union(*words.values()) == validation.ROW_CODES
    with pytest.raises(ValueError):
        validation.vocabulary(frozenset("ab"), frozenset("a"), frozenset("a"))


def test_fields_without_provenance(spark):
    from quillon.operators import provenance

    rows = spark.createDataFrame([(1, "x", 5, '{"schema":"s","fields":{"a":1}}'), (2, None, 5, '{"schema":"s","fields":{"b":1}}'), (3, "x", None, "no json")], "k long, a string, b int, provenance string")
    assert sorted(map(tuple, provenance.lacking(rows, "k", ["a", "b"]).collect())) == [(1, "b"), (3, "a")]


def test_provenance_is_parsed_once_a_payload(spark, capsys):
    from quillon.operators import provenance

    rows = spark.createDataFrame([(1, "no json"), (2, '{"schema":"field-provenance-v1","fields":{}}'), (3, '{"schema":"field-provenance-v1","fields":{"a":1,"":{}}}'), (4, '{"schema":"field-provenance-v1","fields":null}'), (5, None)], "k long, provenance string")
    found = provenance.violations(rows, "k")
    wanted = [(1, None, "provenance_payload_invalid"), (3, "", "provenance_field_name_invalid"), (3, "a", "provenance_field_invalid"), (4, None, "provenance_fields_invalid"), (5, None, "provenance_payload_invalid")]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)
    found.explain("extended")
    optimized = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert optimized.lower().count("parsejson") + optimized.lower().count("parse_json") == 1, optimized


def test_field_provenance_moves_its_tokens_once(spark, sf_dir, capsys):
    from quillon.plans.catalogue import QUERIES

    QUERIES["field_provenance"](spark, sf_dir).explain()
    assert capsys.readouterr().out.count("Exchange ") == 1


def test_backfills_test_all_in_one_pass(spark, monkeypatch):
    import pytest

    from quillon.operators import backfill

    one = lambda data, schema: spark.createDataFrame(data, schema)
    older = {
        "artifacts": one([(1, "XLSX")], "source_artifact_id long, source_kind string"), "batches": one([(1, 1)], "import_batch_id long, source_artifact_id long"),
        "records": one([("a", 1, "PARSED"), ("a", 2, "PARSED"), ("b", 3, "IGNORED")], "raw_record_id string, row_number int, parse_outcome string"), "movements": one([("a", "E"), ("a", "F")], "raw_record_id string, amount_source_column string"),
    }
    passes, refuse = [], backfill._refuse
    monkeypatch.setattr(backfill, "same", lambda *a: passes.append("same") or True)
    monkeypatch.setattr(backfill, "_refuse", lambda rows, *rules: passes.append(rules[0][0]) or refuse(rows, *rules))
    assert backfill.forward(**older)["records"].count() == 5 and passes == ["source_kind_unknown", "row_number_invalid"]
    for data, code in (([("a", "E")], "parsed_rows_and_movements_differ"), ([("a", "E"), ("a", "E"), (None, "E")], "movement_of_unparsed"), ([("a", "E"), ("b", "F")], "movement_of_unparsed"), ([("a", "E"), ("a", None)], "amount_column_unknown")):
        with pytest.raises(backfill.Refused, match=code):
            backfill.forward(**{**older, "movements": one(data, "raw_record_id string, amount_source_column string")})


def test_result_graph_counts_equal_numbers_without_a_table_of_them(spark):
    rows = {1: [1, 2, 3], 2: [1, 2, 2], 3: [1, 3, 3], 4: [2, 3], 5: [1, None, 3], 6: [None], 7: [1, 1]}
    made = [(k, n, "PARSED", None, "1.00") for k, numbers in rows.items() for n in numbers] + [(8, 1, "IGNORED", None, None), (8, 2, "IGNORED", ["c"], "0.00"), (8, 3, None, ["c"], None), (8, 4, "OTHER", ["c"], None)]
    made = spark.createDataFrame(made, "b long, row_number int, outcome string, codes array<string>, a string").withColumn("signed_amount", F.col("a").cast("decimal(20,2)"))
    summary = spark.createDataFrame([(k, len(v), 0, 0) for k, v in rows.items()] + [(8, 0, 1, 0), (9, 0, 0, 0)], "b long, parsed long, ignored long, rejected long")
    found = validation.result_graph(made, summary, "b")
    wrong = {(r.constraint_name, r.key) for r in found.collect()}
    assert wrong == {("row_numbers_contiguous", k) for k in "234567"} | {(n, "8") for n in ("outcome_known", "codes_match_outcome", "amount_matches_outcome", "amount_not_zero", "counts_match")}


def test_result_violations_deals_rows_out_once(spark, sf_dir):
    plan = evidence_plans.result_violations(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2 and "HashAggregate(keys=[import_batch_id" in plan and "distinct" not in plan
