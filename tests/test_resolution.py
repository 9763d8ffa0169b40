"""The resolution process against a plain fold over accounts, on made commands and on the given tables."""

import datetime
import random
from collections import Counter
from decimal import Decimal

from pyspark.sql import functions as F

from quillon.operators import resolution
from quillon.operators.components import components
from quillon.plans import resolution as plans
from quillon.plans.catalogue import QUERIES, SQL

CODES = """movement_date_mismatch origin_movement_exists movement_candidate_exists movement_id_missing movement_not_found movement_account_mismatch movement_currency_mismatch movement_amount_mismatch
 origin_movement_mismatch conflict_movement_mismatch successor_observation_missing successor_observation_not_found successor_account_mismatch successor_observation_same successor_raw_record_mismatch
 successor_not_fresh successor_already_used successor_claim_unchanged observation_not_found resolution_action_invalid observation_transition_invalid resolution_idempotency_conflict
 occurrence_date_invalid allow_exact_collision_invalid idempotency_key_invalid decision_source_invalid policy_name_invalid policy_version_invalid reason_code_invalid""".split()


def test_query_agrees_with_its_recursive_sql(same):
    same(QUERIES["resolution_process"], SQL["resolution_process"])


def test_commands_of_the_query_meet_every_code(duck):
    met = {c for (c,) in duck.execute(f"SELECT DISTINCT code FROM ({SQL['resolution_process']})").fetchall()}
    assert not set(CODES) - met, set(CODES) - met


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)]
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {k: find(k) for k in root} and len(found) == len(root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


DAY = datetime.date(2024, 1, 1)
COMMAND = "n long, command_id long, observation_id long, action string, movement_id string, successor_id long, occurrence_date date, decision_source string, policy_name string, policy_version string, reason_code string, idempotency_key string, allow_exact_collision boolean, allowed_raw_record_ids array<long>"
CLAIM = "observation_id long, account_id long, raw_record_id long, transaction_date date, accounting_date date, signed_amount decimal(20,2), currency string, description string, source_reference string, interpretation_method string, interpretation_version string, state string, state_version int, current_movement_id string, used boolean"
HELD = "movement_id string, raw_record_id long, account_id long, occurrence_date date, signed_amount decimal(20,2), currency string"


def plain(commands, claims, held):
    """One list of movements and one of resolutions, searched again for every command."""
    movements, log = [dict(zip(("id", "raw", "account", "day", "amount", "currency"), m, strict=True)) for m in held], []
    names = [c.split()[0] for c in CLAIM.split(", ")]
    claims = {c[0]: dict(zip(names, c, strict=True)) for c in claims}
    state = {k: [c["state"] or "UNRESOLVED", c["state_version"] or 0, c["current_movement_id"]] for k, c in claims.items()}
    facts = [c.split()[0] for c in CLAIM.split(", ")][3:11]
    out = {}
    for row in sorted(commands):
        c = dict(zip([x.split()[0] for x in COMMAND.split(", ")], row, strict=True))
        o = claims.get(c["observation_id"])

        def code():
            first = next((r for r in log if r["idempotency_key"] == c["idempotency_key"]), None)
            if first:
                fields = ["observation_id", "action", "successor_id", "decision_source", "policy_name", "policy_version", "reason_code"]
                fields += {"CONFIRM_NEW": ["occurrence_date"], "MATCH_EXISTING": ["movement_id"], "MARK_CONFLICT": ["movement_id"], "REJECT": ["movement_id"]}.get(c["action"], [])
                return "RETRIED" if all(first[f] == c[f] for f in fields) else "resolution_idempotency_conflict"
            if o is None:
                return "observation_not_found"
            now, _, current = state[o["observation_id"]]
            if (c["action"], now) not in {(a, b) for a, b, _ in resolution.TRANSITIONS}:
                return "observation_transition_invalid"
            by_id = next((m for m in movements if m["id"] == c["movement_id"]), None)
            own = sorted((m["id"] for m in movements if m["raw"] == o["raw_record_id"]), key=lambda x: x.startswith("m-"))
            if c["action"] == "CONFIRM_NEW":
                if c["occurrence_date"] not in (o["transaction_date"], o["accounting_date"]):
                    return "movement_date_mismatch"
                if own:
                    return "origin_movement_exists"
                there = {m["raw"] for m in movements if (m["account"], m["day"], m["amount"], m["currency"]) == (o["account_id"], c["occurrence_date"], o["signed_amount"], o["currency"])}
                if there and (not c["allow_exact_collision"] or c["allowed_raw_record_ids"] is not None and there != set(c["allowed_raw_record_ids"])):
                    return "movement_candidate_exists"
            if c["action"] in ("MATCH_EXISTING", "MARK_CONFLICT"):
                if c["movement_id"] is None:
                    return "movement_id_missing"
                if by_id is None:
                    return "movement_not_found"
                if by_id["account"] != o["account_id"]:
                    return "movement_account_mismatch"
                if by_id["currency"] != o["currency"]:
                    return "movement_currency_mismatch"
                if c["action"] == "MARK_CONFLICT":
                    return "conflict_movement_mismatch" if now == "RESOLVED" and current != c["movement_id"] else None
                if by_id["amount"] != o["signed_amount"]:
                    return "movement_amount_mismatch"
                if own and own[0] != c["movement_id"]:
                    return "origin_movement_mismatch"
            if c["action"] == "SUPERSEDE":
                s = claims.get(c["successor_id"])
                if c["successor_id"] is None:
                    return "successor_observation_missing"
                if s is None:
                    return "successor_observation_not_found"
                if s["account_id"] != o["account_id"]:
                    return "successor_account_mismatch"
                if s is o:
                    return "successor_observation_same"
                if s["raw_record_id"] != o["raw_record_id"]:
                    return "successor_raw_record_mismatch"
                if state[s["observation_id"]] != ["UNRESOLVED", 0, None] or any(r["observation_id"] == s["observation_id"] for r in log):
                    return "successor_not_fresh"
                if any(r["action"] == "SUPERSEDE" and r["successor_id"] == c["successor_id"] for r in log):
                    return "successor_already_used"
                if all(s[f] == o[f] for f in facts):
                    return "successor_claim_unchanged"
            return None

        found = code()
        if found is None:
            now, version, current = state[o["observation_id"]]
            to = next(t for a, b, t in resolution.TRANSITIONS if (a, b) == (c["action"], now))
            led = {"CONFIRM_NEW": f"m-{o['raw_record_id']}", "REOPEN": current, "SUPERSEDE": current}.get(c["action"], c["movement_id"] if c["action"] != "REJECT" else None)
            if c["action"] == "CONFIRM_NEW":
                movements.append({"id": led, "raw": o["raw_record_id"], "account": o["account_id"], "day": c["occurrence_date"], "amount": o["signed_amount"], "currency": o["currency"]})
            state[o["observation_id"]] = [to, version + 1, led if to in ("RESOLVED", "CONFLICT") else None]
            log.append(c)
            found = ("APPLIED", to, version + 1, led)
        out[c["n"]] = found
    return out


def made(seed, n=400, accounts=3):
    rng = random.Random(seed)
    claims = [(k, rng.randrange(accounts), k // 2, rng.choice((None, DAY)), DAY + datetime.timedelta(k % 2), Decimal(rng.randrange(1, 4)), rng.choice(("CLP", "CLP", "CLP", "USD")), rng.choice("ab"), None, "m", "v", None, None, None, False) for k in range(40)]
    claims = [c if k % 2 == 0 or rng.random() < 0.2 else (c[0], claims[k - 1][1], *c[2:]) for k, c in enumerate(claims)]
    held = [(f"x-{k}", rng.choice((k, -k)), rng.randrange(accounts), DAY, Decimal(rng.randrange(1, 4)), "CLP") for k in range(1, 8)]
    commands = []
    for n_ in range(n):
        key = rng.randrange(42)
        action = rng.choice(("CONFIRM_NEW",) * 3 + ("MATCH_EXISTING",) * 2 + ("MARK_CONFLICT", "REOPEN", "REOPEN", "SUPERSEDE", "SUPERSEDE", "REJECT"))
        movement = rng.choice((None, f"m-{key // 2}", f"m-{rng.randrange(20)}", f"x-{rng.randrange(9)}"))
        allowed = rng.choice((None, [rng.randrange(20)], [-rng.randrange(8), rng.randrange(20)], []))
        commands.append((n_, n_, key, action, movement, rng.choice((None, key ^ 1, key ^ 1, rng.randrange(42))), rng.choice((DAY, DAY, DAY + datetime.timedelta(1))), "HUMAN", "p", "v", "r", f"k{n_ if rng.random() < 0.8 else rng.randrange(n)}", rng.random() < 0.6, allowed))
    return commands, claims, held


def test_against_a_plain_fold(spark):
    for seed in range(3):
        commands, claims, held = made(seed)
        frames = [spark.createDataFrame(rows, kind) for rows, kind in ((commands, COMMAND), (claims, CLAIM), (held, HELD))]
        found = resolution.resolve(*frames, ["n"]).collect()
        want = plain(commands, claims, held)
        assert len(found) == len(commands)
        for r in found:
            w = want[r["n"]]
            got = ("APPLIED", r["to_state"], r["sequence"], r["resolved_movement_id"]) if r["decision"] == "APPLIED" else r["decision"] or r["code"]
            assert got == w, (seed, r)
        seen = Counter(w if isinstance(w, str) else w[0] for w in want.values())
        assert len(seen) > 8, seen


def test_groups_split_a_hot_account(spark, sf_dir):
    one = plans.claims(spark, sf_dir).withColumns({"account_id": F.lit(1).cast("long"), "signed_amount": F.expr("CAST(observation_id div 16 + 1 AS DECIMAL(20,2))")})
    rows = resolution.groups(resolution.with_facts(plans.commands(spark, sf_dir), one, plans.held(spark, sf_dir)))
    counts = [r["count"] for r in rows.groupBy("group").count().collect()]
    assert len(counts) > 20 and max(counts) < 0.2 * sum(counts)


def test_nothing_to_do(spark, sf_dir):
    none = plans.commands(spark, sf_dir).limit(0)
    assert resolution.resolve(none, plans.claims(spark, sf_dir), plans.held(spark, sf_dir), ["n"]).count() == 0


def test_the_same_in_one_batch_in_ten_and_after_a_stop(spark, tmp_path):
    from quillon.streaming import commands as stream

    commands, claims, held = made(7, n=120)
    account = {c[0]: c[1] for c in claims}
    # keys count within an account
    commands = [(*c[:11], f"{account[c[2]]}-{c[11]}", *c[12:]) for c in commands if c[2] in account]
    claims_, held_ = spark.createDataFrame(claims, CLAIM), spark.createDataFrame(held, HELD)
    want = plain(commands, claims, held)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for name, size, stop in (("one", 120, None), ("ten", 12, None), ("stopped", 12, 4)):
            folder, out, state = str(tmp_path / name), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-state")

            def run(rows, folder=folder, out=out, state=state):
                for k, a in enumerate(rows):
                    spark.createDataFrame(commands[a : a + size], COMMAND).coalesce(1).write.mode("append").parquet(folder)
                source = spark.readStream.schema(COMMAND).option("maxFilesPerTrigger", 1).parquet(folder)
                found = stream.resolve(source, claims_, held_, ["n"], ["n"])
                query = found.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(out, format="parquet")
                query.awaitTermination(300)

            starts = list(range(0, len(commands), size))
            run(starts if stop is None else starts[:stop])
            if stop is not None:
                run(starts[stop:])
            rows = spark.read.parquet(out).collect()
            assert len(rows) == len(commands)
            for r in rows:
                got = ("APPLIED", r["to_state"], r["sequence"], r["resolved_movement_id"]) if r["decision"] == "APPLIED" else r["decision"] or r["code"]
                assert got == want[r["n"]], (name, r)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_only_what_claims_share_links_them(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(resolution, "components", lambda edges: seen.append(edges) or components(edges))
    rows = resolution.with_facts(plans.commands(spark, sf_dir).filter("g < 4"), plans.claims(spark, sf_dir), plans.held(spark, sf_dir))
    found = resolution.groups(rows)
    assert found.count() == rows.count() and not found.filter("group IS NULL").count()
    claims = {r[0] for r in rows.select(F.xxhash64(F.lit("claim"), "observation_id")).distinct().collect()}
    edges = seen[0].collect()
    assert edges and {n for e in edges for n in e} <= claims
