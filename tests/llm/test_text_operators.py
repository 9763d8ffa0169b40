"""Operators on texts, against the library, brute force or exact values on small tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import bpe, common, html_text, language, near_dup, packing, quality, queries, similar, toxicity

ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "no key"), (4, "x " * 30_000), (5, "y" * 20_000), (6, "é中 ½\u3000z<|endoftext|>!"), (7, "  \n\t "), (8, "It's  two\n\n lines 12's")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, 1, "z", 0.5, 9) for r in ODD], SCHEMA + ", piece int, length int, lang_pred string, score double, ids int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA + ", lang string")


def test_long_sheets_and_deep_lists_take_linear_time():
    import time

    for page in ("<style>" + "a b c " * 100_000 + "</style>x", "<style>" + ".a{color:red}" * 50_000 + "</style>x", "<style>" + "{" * 200_000 + "</style>x", "<ul><li>x" * 40_000):
        began = time.process_time()
        text = html_text.text_of(page)
        assert time.process_time() - began < 10 and len(text) < 20 * len(page)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_ids_equal_the_librarys(library):
    own, fast, rng = bpe.Encoder(queries.vocabulary(), cache_entries=64), bpe.ids_of(queries.vocabulary()), random.Random(3)
    parts = [*" \n\t\r\xa0\u3000\x85\x1c'sabcdtrevl.,!?0189éüß中한½😀", "<|endoftext|>", "  ", "'re", " the", "aaaa"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [t or "" for _, t in ODD]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids == fast(t).tolist()
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert len(fast(" " * 1_500_000)) == len(own.encode(" " * 1_500_000))


def test_encode_keeps_rows_and_clashing_columns(odd, none, library):
    rows = bpe.encode(odd, queries.vocabulary()).collect()
    assert len(rows) == len(ODD) and all(r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == (r["text"] or "") for r in rows)
    assert bpe.digests(none, queries.vocabulary()).count() == 0
    r = bpe.digests(odd.filter("doc_id = 2"), queries.vocabulary()).first()
    assert (r["n_tokens"], r["ids_sha256"]) == (0, hashlib.sha256(b"").hexdigest())


def check_packing(rows, docs, library, size):
    got = Counter()
    for r in rows:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
    want = Counter()
    for key, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % size or size, len(ids), size), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[key, k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))] += 1
    assert got == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing(odd, none, library, spark, sf_dir):
    rows = packing.pack(packing.pieces(odd, queries.vocabulary(), 64), 64).collect()
    check_packing(rows, ODD, library, 64)
    assert packing.pack(packing.pieces(none, queries.vocabulary())).count() == 0
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.op1_packing(spark, sf_dir).collect()
    n = check_packing(rows, docs, library, 1024)
    assert n <= -(-sum(r["length"] for r in rows) // 1024) + 3


def test_fullest_is_the_best_subset():
    rng = random.Random(5)
    for _ in range(200):
        lengths, room = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))], rng.randint(0, 60)
        best = max(s for m in range(1 << len(lengths)) if (s := sum(x for k, x in enumerate(lengths) if m >> k & 1)) <= room)
        found = packing.fullest(Counter(lengths), room)
        assert sum(found) == best and not Counter(found) - Counter(lengths)


def brute_components(rows, shingle):
    import xxhash

    prints = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            least[find(k)] = min(least.get(find(k), key), key)
    return Counter((key, prints[k], least.get(find(k))) for k, (key, _) in enumerate(rows))


def test_near_duplicates(spark, odd, none, sf_dir):
    words = [f"w{k}" for k in range(400)]
    near = [(100 + k, " ".join(words[:k] + ["other"] + words[k + 1 :])) for k in range(0, 40)]
    rows = [*ODD, *near, *((200 + k, "Same Text here again") for k in range(30))]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in found) == brute_components(rows, 4)
    assert near_dup.near_duplicates(none).count() == 0
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = queries.op5_near_dup(spark, sf_dir).collect()
    assert Counter((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in found) == brute_components(docs, 4)


def brute_groups(rows, similarity):
    sets = {i: set(similar.shingle_set(t, 5).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in sets}


def test_similar_texts(spark, odd, none, sf_dir):
    kept = similar.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r[0] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 8]
    assert similar.keep_one(none).count() == 0
    rng = random.Random(3)
    words = [f"w{k}" for k in range(900)]
    rows = []
    for k in range(40):  # 0 to 7 words of 300 changed: similarities of 1 to 0.8
        own = [rng.choice(words) for _ in range(300)]
        rows.append((10 * k, " ".join(own)))
        for n in range(1, 8):
            for at in rng.sample(range(300), k % 8):
                own[at] = "x"
            rows.append((10 * k + n, " ".join(own if n == 1 else [*own[: 290 + n], "and", "more"])))
    rows += [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text").collect()]
    found = {r["doc_id"]: r["component_id"] for r in similar.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_groups(rows, 0.8)
    assert found == want


def test_no_similar_pair_is_missed(spark):
    """Short texts at exactly 0.8 and a little below, whose fingerprints often share no key."""
    rng = random.Random(7)
    rows = []
    for k in range(300):
        common, more = ((8, 1), (16, 3), (16, 4))[k % 3]  # 4 of 5, 12 of 15 and 12 of 16 shingles
        own = [f"v{rng.randrange(10**6)}" for _ in range(common + more)]
        rows += [(2 * k, " ".join(own[:common])), (2 * k + 1, " ".join(own))]
    # a line that all have, and texts that are little more than it
    line = "this line stands in every text of the table"
    rows += [(1000 + k, f"{line} {' '.join(f'u{k}x{j}' for j in range(k % 4))}") for k in range(60)]
    found = {r["doc_id"]: r["component_id"] for r in similar.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute_groups(rows, 0.8)


def test_buckets_bound_what_sets_share():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(0, 900))) for _ in range(2))
        most = similar.most_common(similar.bucketed(a), similar.bucketed(b))
        both = len(np.intersect1d(a, b))
        assert both <= most <= min(len(a), len(b))
        x, y = similar.bitmap(a).view(np.uint64), similar.bitmap(b).view(np.uint64)
        assert both <= len(a) - np.bitwise_count(x & ~y).sum() and both <= len(b) - np.bitwise_count(y & ~x).sum()
    same = np.arange(300, dtype=np.uint64) << np.uint64(20)
    assert similar.most_common(similar.bucketed(same), similar.bucketed(same)) is None


def test_chains_are_followed(spark):
    """Fingerprints in a chain, each four bits from the next, in shuffled order."""
    chain, x = [], 0
    for k in range(0, 60, 4):
        x |= 15 << k
        chain.append(x)
    random.Random(1).shuffle(chain)
    frame = spark.createDataFrame([(k + 10, c) for k, c in enumerate(chain)], "node long, print long")
    assert {r["root"] for r in near_dup.classes(frame).collect()} == {10}
    apart = spark.createDataFrame([(1, 0), (2, 31), (3, 31 << 10)], "node long, print long")
    assert len({r["root"] for r in near_dup.classes(apart).collect()}) == 3


@pytest.mark.parametrize("split", [(0, 0, 0), (1, 0, 0), (2, 0, 0), (1, 1, 0), (3, 0, 0), (2, 1, 0), (1, 1, 1), (4, 0, 0), (3, 1, 0), (2, 2, 0), (2, 1, 1)])
def test_linked_fingerprints_share_a_key(split):
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 1000, dtype=np.uint64) << np.uint64(1)

    def keys_of(x):
        own = [set() for _ in x]
        for r, k in zip(*map(np.ndarray.tolist, near_dup.keys(x)), strict=True):
            own[r].add(k)
        return own

    first = keys_of(a)
    for errors in set(itertools.permutations(split)):
        b = a.copy()
        for (low, n), e in zip(near_dup.SEGMENTS, errors, strict=True):
            for j in np.argsort(rng.random((len(a), n)), axis=1)[:, :e].T:
                b ^= np.uint64(1) << (j + low).astype(np.uint64)
        assert all(x & y for x, y in zip(first, keys_of(b), strict=True))


def folders(spark):
    import os

    from quillon.llm.common import shared_dir

    return set(os.listdir(shared_dir(spark)))


def test_scratch_is_deleted(spark, sf_dir):
    """Only the tables that a lazy result reads are left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = folders(spark)
    similar.keep_one(docs)
    near_dup.near_duplicates(docs)
    left = {name.rsplit("-", 1)[0] for name in folders(spark) - before}
    assert left == {"groups", "kept", "fingerprints", "classes"}
    with common.scratch():
        before = folders(spark)
        assert similar.keep_one(docs).count()
    assert folders(spark) <= before


def brute_statistics(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often, inside = Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            inside.update(range(k, k + 5))
    n = len(words)
    return n, sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), n < 10 or 100 * len(inside) > 20 * n


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_statistics_and_rules(spark, odd, none, sf_dir):
    more = [(20, "a b c d e f a b c d e g h i j k l m"), (21, "x y\nx y\n \nx y\nq"), (22, "a#b *$ %&|<>  c"), (23, "a a a a a a a a a a a a")]
    rows = quality.rate(spark.createDataFrame([*ODD, *more], SCHEMA), []).collect()
    assert [tuple(r[n] for n in NAMES) for r in rows] == [brute_statistics(r["text"]) for r in rows]
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)
    assert quality.rate(none, [[("symbols", ">", 0.5)]]).count() == 0
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op3_quality(spark, sf_dir).collect():
        assert tuple(r[n] for n in NAMES) == brute_statistics(text[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_rules_are_learned(spark):
    rng = random.Random(2)
    rows = [{f: rng.random() for f in quality.FEATURES} | {"fold": k % 3} for k in range(900)]
    for r in rows:
        r["poor"] = int(r["symbols"] > 0.8 and r["upper"] <= 0.5 or r["repeats"] > 0.9)
    rules = quality.learn(rows)
    assert rules and sum(any(quality._holds(x, r) for x in rules) == r["poor"] for r in rows) > 870
    assert quality.learn([r | {"poor": 0} for r in rows]) == []
    frame = spark.createDataFrame([{f: r[f] for f in quality.FEATURES} for r in rows[:50]])
    got = [r[0] for r in frame.select(quality.verdict(rules)).collect()]
    assert got == [not any(quality._holds(x, r) for x in rules) for r in rows[:50]]


def test_gradients_by_differences():
    import numpy as np

    rng = np.random.default_rng(0)
    net = language.BiGru(3, hidden=4, embed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y, w = rng.integers(0, 256, (5, 4)).astype(np.uint8), rng.integers(0, 3, 5), rng.random(5)
    _, g = net.gradients(x, y, w)
    for name, at in (("out", (1, 2)), ("hf", (0, 5)), ("hb", (2, 9)), ("xf", (1, 1)), ("bb", (7,)), ("embed", (int(x[0, 1]), 0))):
        kept, e = net.p[name][at], 1e-3
        net.p[name][at] = kept + e
        up = net.gradients(x, y, w)[0]
        net.p[name][at] = kept - e
        down = net.gradients(x, y, w)[0]
        net.p[name][at] = kept
        assert abs((up - down) / (2 * e) - g[name][at]) < 2e-4


def test_language_reads_texts_together_by_their_bytes(monkeypatch):
    texts = [None if k % 7 == 0 else "x" * (k % 30) for k in range(3000)]
    batch = pa.RecordBatch.from_pydict({"__text": pa.array(texts, pa.string())})
    assert [p.num_rows for p in language._pools(batch)] == [3000]
    monkeypatch.setattr(language, "POOL", 100)
    parts = [p.column("__text").to_pylist() for p in language._pools(batch)]
    assert sum(parts, []) == texts and len(parts) > 300 and all(sum(map(len, filter(None, p[:-1]))) <= 100 for p in parts)
    assert [p.num_rows for p in language._pools(batch.slice(0, 0))] == [0]


def test_language_network_with_gates_wide_open(recwarn):
    net = language.BiGru(3, hidden=4, embed=3, seed=1)
    for name in ("xf", "xb", "hf", "hb"):
        net.p[name] *= 100
    x = np.random.default_rng(0).integers(0, 256, (5, 40)).astype(np.uint8)
    both = np.concatenate([net._run(x, "f"), net._run(x[:, ::-1], "b")[::-1]], axis=2)
    e = np.exp(both @ net.p["out"] + net.p["out_b"])
    assert np.allclose(net.probabilities(x), e / e.sum(axis=2, keepdims=True), atol=1e-4) and not len(recwarn)


def test_language(spark, odd, none, sf_dir):
    found = queries.op4_language(spark, sf_dir).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in found if r["held_out"]]
    assert len(found) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in found)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.95 * len(held)
    model = language.fit(spark.createDataFrame([(1, "der die das und", "de"), (2, "the and of", "en"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string"), F.lit(True))
    rows = language.identify(odd, model).collect()
    assert len(rows) == len(ODD) and all((r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or ""))) for r in rows)
    assert all(sum((r["positions"] or {}).values()) == len((r["text"] or "").encode()) for r in rows)
    assert language.fit(none, F.lit(True)) is None
    assert {r["lang_pred"] for r in language.identify(odd, None).collect()} == {"und"}


def test_probabilities_by_plain_steps():
    """The fast pass against the states of the textbook's formula, position by position."""
    import numpy as np

    net = language.BiGru(3, hidden=4, embed=3, seed=1)
    x = np.random.default_rng(2).integers(0, 256, 40).astype(np.uint8)
    sig = lambda v: 1 / (1 + np.exp(-v))
    sides = []
    for d, data in (("f", x), ("b", x[::-1])):
        h, out = np.zeros(4), []
        for byte in data:
            gx, gh = net.p["embed"][byte] @ net.p[f"x{d}"] + net.p[f"b{d}"], h @ net.p[f"h{d}"]
            r, z = sig(gx[:4] + gh[:4]), sig(gx[4:8] + gh[4:8])
            n = np.tanh(gx[8:] + r * gh[8:])
            h = (1 - z) * n + z * h
            out.append(h)
        sides.append(np.array(out))
    logits = np.concatenate([sides[0], sides[1][::-1]], axis=1) @ net.p["out"] + net.p["out_b"]
    want = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert np.abs(net.probabilities(x[None])[:, 0] - want).max() < 1e-5


def test_a_hot_key_sends_a_bounded_sample_to_the_driver(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "train", lambda docs, **_: seen.extend(docs))
    docs = spark.range(5000).selectExpr("1 AS doc_id", "concat('w', id, repeat(' word', 20000)) AS text", "'en' AS lang")
    language.fit(docs.limit(400), F.lit(True), n_docs=50)
    assert 0 < len(seen) <= 50 and max(len(t) for t, _ in seen) <= language.FIT_CHARS


def test_windows_read_as_in_one_go(monkeypatch):
    """Labels of documents in windows against one pass over each, one document at a time."""
    import numpy as np

    rng = random.Random(2)
    own = {"en": "the and of with which they are from", "de": "der und die mit welche sie sind von", "fr": "le et la avec que ils sont dans"}
    text = lambda lang, n: " ".join(rng.choice(own[lang].split()) for _ in range(n)).encode()
    languages, net = language.train([(text(lang, 200), lang) for lang in own], steps=120)
    texts = [text(rng.choice(list(own)), n) for n in (0, 1, 5, 60, 900, 2000)] + [b" " * 9000, bytes(rng.randrange(256) for _ in range(9000))]
    monkeypatch.setattr(language, "BLOCK", 3000)
    # with so short a run before each window, the state has to be carried on
    monkeypatch.setattr(language, "WARM_UP", 2)
    monkeypatch.setattr(language, "WINDOW", 64)
    monkeypatch.setattr(language, "TOLERANCE", 1e-5)
    assert (found := language.Windows(net, texts)).read(np.arange(len(found.at)), 2) is None and found.settle() > 0
    sums, labels = language.pooled(net, texts)
    for k, t in enumerate(texts):
        prob = net.probabilities(np.frombuffer(t, np.uint8)[None, :])[:, 0]
        assert np.abs(sums[k] - prob.sum(axis=0, dtype=np.float64)).max() < 1e-5 * max(1, len(t)) and labels[k].sum() == len(t)
        assert np.abs(labels[k] - np.bincount(prob.argmax(axis=1), minlength=3)).max() <= 2


def test_toxicity(spark, odd, none, sf_dir):
    found = queries.op6_toxicity(spark, sf_dir).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    rng = random.Random(4)
    plain = [" ".join(rng.choice(["good", "fine", "day", "sun", "tree", "road"]) for _ in range(20)) for _ in range(200)]
    rows = [(k, t + (" nastyword" if k % 5 == 0 else ""), int(k % 5 == 0)) for k, t in enumerate(plain)]
    docs = spark.createDataFrame([r[:2] for r in rows], SCHEMA)
    labels = spark.createDataFrame([(k, t) for k, _, t in rows] + [(3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 2 == 0)
    got = toxicity.score(docs, model).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in got)
    assert len(toxicity.score(odd, model).collect()) == len(ODD)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.fit(none, labels.limit(0), F.lit(True)) is None
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<title>no</title><p>one<p>two", "one\n\ntwo"),
        ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>", "- a\n- b\n  3. c\n  4. d"),
        ("<table><tr><th>Name<th>Qty<tr><td>pie<td>12</table>after", "Name | Qty\npie  | 12\n\nafter"),
        ("a<script>x<p></script>b<style>.q{display:none}</style><div class='p q'>no</div><i hidden>no</i>c", "abc"),
        ("x<br>y<pre> 1\n  2</pre>", "x\ny\n\n 1\n  2"),
        ("<div>a<div style='display: NONE'>b</div><span aria-hidden=true>c</span></div>d", "a\nd"),
        ("<details><summary>s</summary>gone</details><!-- no --><b>e</b>nd", "s\nend"),
        ("<p>1 < 2 <b>and</b> <i>so</i>\n on", "1 < 2 and so on"),
        ("<style>@media print{.x{display:none}}</style><p class=x>seen", "seen"),
        ("<style>@import 'a.css'; @media screen and (min-width: 1px){.x{display:none}} .y{color:red}</style><p class=x>no<p class=y>yes", "yes"),
        ("<style>/* .y{display:none} */ p.z{display:none} @font-face{display:none} .x,i{visibility:hidden}</style><p class=x>no<b style='visibility:visible'>shown</b><p class=y>yes<i>no</i>", "shown\n\nyes"),
        ("<style>.x{visibility:hidden}.y{visibility:visible}</style><table class=x><tr><td>a<td class=y>b<tr class=y><td>c</table>", "  | b\nc"),
        ("<dialog>closed</dialog><dialog open>open</dialog>", "open"),
    ],
)
def test_html(page, text):
    assert html_text.text_of(page) == text


def test_html_shows_all_that_is_visible():
    assert html_text.text_of("<table><tr>x<td>a</td>y<td>b</td><img alt=p><input value=q></table>") == "x\ny\np\nq\na | b"
    assert html_text.text_of("<p><math><mi>n</mi><annotation>no</annotation></math> <svg><desc>no</desc><text>s</text></svg>") == "n s"
    assert html_text.text_of("<ul><li>a" + "<b>" * 100 + "<li>b</ul>") == "- a\n- b"
    assert html_text.text_of("<table><tr><td>a" + "<font>" * 100 + "<td>b</table>") == "a | b"


@pytest.mark.parametrize("page", ['<a "' * 1_200_000, "<div>" * 400_000 + "</b>" * 400_000, "<a '\"" * 900_000, "<p " + "x " * 2_000_000])
def test_html_of_odd_pages_takes_linear_time(page):
    import time

    began = time.process_time()
    html_text.text_of(page)
    assert time.process_time() - began < 40


def test_html_table(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "<p>é", "y"), (2, "<p>é", "y"), (3, "<div>" * 30_000 + "deep", "z"), (4, "<table><tr><td>" * 60 + "in", "q")], "page_id long, html string, text string")
    rows = html_text.extract(pages).collect()
    assert [(r["page_id"], r["text"]) for r in rows] == [(1, ""), (2, "é"), (2, "é"), (3, "deep"), (4, "in")]
    assert html_text.extract(pages.limit(0)).count() == 0
