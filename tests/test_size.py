"""What queries deal out between tasks and write to the shared folder: sources, not what they make of them."""

import pathlib

from pyspark.sql import functions as F

from quillon.operators import resolution
from quillon.operators.shared import written
from quillon.plans import card as card_plans
from quillon.plans import historical as historical_plans
from quillon.plans import layouts as layout_plans
from quillon.plans import resolution as resolution_plans
from quillon.sources import card, historical, tokens


def test_lines_of_a_document_are_those_of_a_table(spark):
    """Also for means that move, ties between two lines, marks in words, a page without lines in between."""
    import random

    rng = random.Random(11)
    data = [(rng.choice("abc"), rng.choice((1, 2, 4)), k, rng.choice(["Fécha", " x  Y", "ﬁn", "", "77"]), float(rng.randrange(9)), 20.0, rng.randrange(60) / 4, 0.0) for k in range(400)]
    frame = spark.createDataFrame([(*t[:7], t[6] + rng.choice((6.0, 6.5, 9.0))) for t in data], "doc_id string, page int, ordinal int, text string, x0 double, x1 double, y0 double, y1 double")
    line = ("page", "line", "y0", "y1", "key", "t")
    want = {(r["doc_id"], *(r[c] for c in line)) for r in map(lambda r: r.asDict() | {"t": tuple(map(tuple, r["t"]))}, historical._lines(tokens.lines(frame)).collect())}
    docs = frame.groupBy("doc_id").agg(F.collect_list(F.struct("page", "ordinal", "text", "x0", "x1", "y0", "y1")).alias("tokens")).union(spark.createDataFrame([("none", None)], "doc_id string, tokens array<struct<page: int, ordinal: int, text: string, x0: double, x1: double, y0: double, y1: double>>"))
    found = {r["doc_id"]: r["lines"] for r in docs.select("doc_id", tokens.lines_of(F.col("tokens")).alias("lines")).collect()}
    assert {(d, *(x[c] if c != "t" else tuple(map(tuple, x[c])) for c in line)) for d, lines in found.items() for x in lines or ()} == want
    assert len(want) > 30 and not found["none"]


def _written(spark, sf_dir, query):
    """What a query's plan deals out, and the tables that it writes meanwhile."""
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("*/rdd-*"))
    plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line], set(folder.glob("*/rdd-*")) - before


def test_token_rows_deal_out_line_items_and_rows_but_no_tokens(spark, sf_dir):
    exchanges, written = _written(spark, sf_dir, historical_plans.historical_token_rows)
    assert [e.split("hashpartitioning(")[1].split("#")[0] for e in exchanges] == ["doc_id", "k", "l_orderkey"] and not written


def test_documents_deal_out_line_items_and_no_tokens(spark, sf_dir):
    exchanges, written = _written(spark, sf_dir, historical_plans.historical_documents)
    assert [e.split("hashpartitioning(")[1].split("#")[0] for e in exchanges] == ["k", "l_orderkey"] and not written


def test_card_rows_are_read_from_tables_that_are_dealt_out(spark, sf_dir):
    dealt = lambda df: [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    lines = dealt(card.gathered(card_plans.tokens(spark, sf_dir)))
    assert [e.split("hashpartitioning(")[1].split("#")[0] for e in lines] == ["k", "l_orderkey"]
    exchanges, written = _written(spark, sf_dir, card_plans.card_rows)
    assert not exchanges and not written


def test_discovery_sends_no_side_of_a_join_through_the_driver(spark, sf_dir):
    exchanges, _ = _written(spark, sf_dir, layout_plans.sheet_discovery)
    assert exchanges and not any("BroadcastExchange" in e for e in exchanges)


def test_commands_are_dealt_out_with_facts_instead_of_claims(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = resolution.with_facts(resolution_plans.commands(spark, sf_dir), resolution_plans.claims(spark, sf_dir), resolution_plans.held(spark, sf_dir))
        plan = rows._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # a claim's columns are not in what joins deal out after the one with successors
    below = [plan[k + 1] for k, line in enumerate(plan) if "Exchange hashpartitioning(o_account#" in line]
    assert below and not any("s__" in line for line in below)
    facts = written(rows.limit(3))
    assert facts.count() == 3 and "FileScan" in facts._jdf.queryExecution().executedPlan().toString() and facts.dtypes == rows.dtypes


def test_card_documents_deal_out_sums_alone(spark, sf_dir):
    exchanges, written = _written(spark, sf_dir, card_plans.card_documents)
    # operands of the equation come from two sides
    assert [e.split("hashpartitioning(")[1].split("#")[0] for e in exchanges] == ["doc_id"] and not written
