"""The registered queries on whole tables against the library or brute force, and the pipeline's stages on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from quillon.llm import media, queries, toxicity


def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_op7_on_the_whole_table(spark, sf_dir):
    from tokenizers import Tokenizer

    library, docs = Tokenizer.from_file(queries.vocabulary()), texts(spark, sf_dir)
    found = queries.op7_bpe(spark, sf_dir).collect()
    assert len(found) == len(docs)
    for r in found:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op9_on_the_whole_table(spark, sf_dir):
    docs, seen = texts(spark, sf_dir), {}
    found = queries.op9_media(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(docs)
    for r in found:
        raw = docs[r["doc_id"]].encode()
        full = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        stored = media.write_jpeg(full, len(raw))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r["feature"] and seen.setdefault(raw, r["feature"]) == r["feature"]
    assert len(set(seen.values())) > 0.9 * len(seen)


def test_label_model_recovers_what_made_the_votes():
    rng = np.random.default_rng(3)
    n, accuracy = 6000, 0.88
    truth = rng.random(n) < 0.3
    says = np.array([[0.02, 0.7], [0.05, 0.5], [0.3, 0.35], [0.4, 0.1]])
    votes = (rng.random((n, 4)) < says[:, truth.astype(int)].T).astype(np.float32)
    # a fifth voter says nearly always what the first says
    votes = np.concatenate([votes, np.where(rng.random((n, 1)) < 0.97, votes[:, :1], rng.random((n, 1)) < 0.3)], axis=1).astype(np.float32)
    labels = np.where(rng.random(n) < accuracy, truth, ~truth)
    p, rates, parent, found = toxicity.posterior(votes, labels)
    assert abs(found - accuracy) < 0.05 and np.abs(rates[:, :4] - says.T).max() < 0.1
    assert parent[4] == 0 or parent[0] == 4
    assert ((p > 0.5) == truth).mean() > max((labels == truth).mean(), 0.9)
    # Bayes' rule over both classes with the parameters that made the votes, for independent voters
    alone, _, _, _ = toxicity.posterior(votes[:, :4], labels)
    odds = np.log(0.3 / 0.7) + np.where(labels, 1, -1) * np.log(accuracy / (1 - accuracy))
    for k, (clean, bad) in enumerate(says):
        odds = odds + np.where(votes[:, k] == 1, np.log(bad / clean), np.log((1 - bad) / (1 - clean)))
    assert np.abs(alone - 1 / (1 + np.exp(-odds))).mean() < 0.05


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    rng = random.Random(2)
    own = {"en": "the and of with which they are from there people house water", "de": "der und die mit welche sie sind von dort leute haus wasser"}
    rows = [(k, " ".join(rng.choice(own[lang].split()) for _ in range(60)) + f" {k}", lang) for k, lang in enumerate(["en", "de"] * 30)]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "!!! 123", "en"), (None, rows[4][1], "en"), (1003, "the and of " * 5000, None), rows[0], rows[0], (1004, rows[6][1], "en")]
    return spark.createDataFrame([(*r, "clash", 1, True, 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, n_words int, kept boolean, score double")


def test_stages_on_odd_rows(spark, sf_dir, odd):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, odd, sf_dir)
        assert found.columns == odd.columns and dict(found.dtypes) == dict(odd.dtypes), name
        rows = found.collect()
        assert 0 < len(rows) <= odd.count() and {r["lang_pred"] for r in rows} == {"clash"}, name
        assert stage(spark, odd.limit(0), sf_dir).count() == 0, name
    kept = {name: stage(spark, odd, sf_dir).collect() for name, stage in corpus_pipeline.STAGES[:-1]}
    ids = [r["doc_id"] for r in kept["language_id"]]
    assert not {1000, 1001, 1002} & set(ids) and ids.count(0) == 3 and None in ids
    # poor or repeating texts go, repeated rows share their lot
    ids = [r["doc_id"] for r in kept["quality_rules"]]
    assert not {1000, 1001, 1002, 1003} & set(ids) and ids.count(0) in (0, 3)
    ids = [r["doc_id"] for r in kept["simhash_near_dedup"]]
    assert ids.count(0) == 1 and 1004 not in ids and 6 in ids
    packed = corpus_pipeline.STAGES[-1][1](spark, odd, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in odd.select("doc_id").distinct().collect()}
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), sf_dir).count() == 0
