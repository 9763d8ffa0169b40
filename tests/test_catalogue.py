import pytest

from quillon.operators.lifecycle import TRANSITIONS
from quillon.plans import card, evidence, historical, imports, layouts, resolution, results  # noqa: F401
from quillon.plans.catalogue import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(name, same):
    same(QUERIES[name], SQL[name])


def test_only_folds_have_no_sql():
    assert set(QUERIES) - set(SQL) == {"classification_replay"}


def test_resolution_replay_against_a_fold(spark, sf_dir):
    rows = sorted(QUERIES["resolution_replay"](spark, sf_dir).collect(), key=lambda r: (r["observation_id"], r["event_id"]))
    times = {r["event_id"]: r["ts"] for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect()}
    legal, state, n = {(a, f): t for a, f, t in TRANSITIONS}, {}, {}
    for r in sorted(rows, key=lambda r: (times[r["event_id"]], r["event_id"])):
        o = r["observation_id"]
        now = state.get(o, "UNRESOLVED")
        assert r["from_state"] == now
        to = legal.get((r["action"], now))
        assert (r["code"] is None) == (to is not None)
        if to:
            state[o], n[o] = to, n.get(o, 0) + 1
            assert r["sequence"] == n[o]
        assert r["to_state"] == state.get(o, "UNRESOLVED")


def test_classification_replay_against_a_fold(spark, sf_dir):
    rows = QUERIES["classification_replay"](spark, sf_dir).collect()
    times = {r["event_id"]: r["ts"] for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect()}
    kinds = {r[0] for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_type").distinct().collect()}
    held, codes = {}, set()
    for r in sorted(rows, key=lambda r: (times[r["command_id"]], r["command_id"])):
        category, revision = held.get(r["movement_id"], (None, 0))
        wanted, code = r["category_id"], None
        if revision == 0 and r["expected_revision"] != 0:
            code = "classification_not_present"
        elif r["expected_revision"] != revision:
            code = "classification_revision_conflict"
        elif wanted is not None and wanted not in kinds:
            code = "category_not_found"
        elif wanted != category and wanted == "ECONOMY":
            code = "category_inactive"
        elif wanted != category:
            held[r["movement_id"]] = wanted, revision + 1
        category, revision = held.get(r["movement_id"], (None, 0))
        assert (r["code"], r["current_category"], r["revision"]) == (code, category, revision)
        codes.add(code)
    assert len(codes) >= 3
