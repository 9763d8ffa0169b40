"""Token counts, divergence of sources and interaction of filters, against the library and brute force."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import divergence, filter_audit, queries, token_counts

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_counts_equal_the_librarys(library):
    rng = random.Random(4)
    own, small = token_counts.Counter(queries.vocabulary()), token_counts.Counter(queries.vocabulary(), cache_entries=16)
    parts = [*" \n\t\r\xa0　\x85\x1c'sabcdtrevl.,!?0189éüß中한½😀", "<|endoftext|>", "  ", "'re", " the", "aaaa"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", "y" * 30_000, " " * 5000, "x " * 9000]
    for t in texts:
        assert own.count(t) == small.count(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_merges_are_popped_in_order_of_rank(library):
    rng, own = random.Random(5), token_counts.Counter(queries.vocabulary())
    for _ in range(500):
        word = "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 40)))
        assert own.word(word.encode()) == len(library.encode(word, add_special_tokens=False).ids)


def test_token_counts_of_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "no key"), (4, "z" * 20_000), (5, "é<|endoftext|>")]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, n_tokens string, n_bytes int")
    found = token_counts.count_tokens(docs, queries.vocabulary(), limit=2).collect()
    assert Counter((r["doc_id"], r["text"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found) == Counter(
        (k, t, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2) for k, t in rows
    )
    assert token_counts.count_tokens(docs.limit(0), queries.vocabulary()).count() == 0


def test_token_counts_query_on_the_whole_table(spark, sf_dir, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries.op12_token_counts(spark, sf_dir).collect()
    assert len(found) == len(docs)
    for r in found:
        n = len(library.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 512)


def test_sorted_pointers(monkeypatch):
    rng = random.Random(6)
    letters = [*"abAB", "é", "中", "zzzzzzzz", " ", " ", "1", "[", "longerthaneightbytes"]
    for short in (1, 4, 1 << 15):
        monkeypatch.setattr(divergence, "SHORT", short)
        for _ in range(60):
            texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 12))]
            raw = [t.encode() for t in texts]
            group = np.array([rng.randrange(3) for _ in texts], np.int64)
            data, starts = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
            shard = divergence.Shard(data, starts)
            order, _ = shard.sort()
            words = [bytes(shard.bytes[a:b]) for a, b in zip(shard.begin, shard.end, strict=True)]
            assert [words[k] for k in order] == sorted(words)
            n, docs = Counter(), Counter()
            for t, g in zip(texts, group.tolist(), strict=True):
                found = [w.translate(LOWER) for w in WORD.findall(t)]
                n.update((w, g) for w in found)
                docs.update((w, g) for w in set(found))
            terms, groups, n_docs, counts = shard.counts(group)
            assert {(t.decode(), g): (a, b) for t, g, a, b in zip(terms, groups.tolist(), n_docs.tolist(), counts.tolist(), strict=True)} == {k: (docs[k], n[k]) for k in n}


def brute_audit(rows, least, smooth, top):
    groups = {(r[1] or "", r[2] or "") for r in rows}
    n, docs = Counter(), Counter()
    for _, lang, source, text in rows:
        found = [w.translate(LOWER) for w in WORD.findall(text or "")]
        n.update((lang or "", source or "", w) for w in found)
        docs.update((lang or "", w) for w in set(found))
    out = []
    for lang, source in groups:
        kept = sorted({w for (a, w), k in docs.items() if a == lang and k >= least})
        total = lambda s: sum(n[lang, s, w] for w in kept)
        share = lambda s: {w: 1 + 10**9 * (n[lang, s, w] + smooth) // (total(s) + smooth * len(kept)) for w in kept}
        others = sorted(b for a, b in groups if a == lang)
        own, every = share(source), {w: sum(n[lang, s, w] for s in others) for w in kept}
        q = {w: 1 + 10**9 * (every[w] + smooth) // (sum(every.values()) + smooth * len(kept)) for w in kept}
        pairs = [(sum(abs(own[w] - p) for w, p in share(s).items()), s) for s in others if s != source]
        terms = [(own[w] - q[w], w) for w in kept if n[lang, source, w] and own[w] > q[w]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= top]
    return Counter(out)


def test_divergence_of_odd_rows(spark, monkeypatch):
    rng = random.Random(7)
    texts = [None, "", "no1words2", "É é e E z", "the The THE cat", "a" * 5000, "x " * 2000]
    rows = [(k, rng.choice((None, "", "en", "de")), rng.choice((None, "s1", "s2", "ß")), rng.choice(texts)) for k in range(150)] + [(1, "fr", "alone", "le"), (2, "xx", "a", None), (3, "xx", "b", "")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, lang string, source string, text string, term string, n int")
    monkeypatch.setattr(divergence, "BLOCK_ROWS", 1)
    found = divergence.audit(docs, least_docs=8, top=2)
    assert Counter(tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect()) == brute_audit(rows, 8, 5, 2)
    assert divergence.audit(docs.limit(0)).count() == 0
    few = divergence.term_counts(docs, shard=64).collect()
    many = divergence.term_counts(docs).collect()
    assert Counter(map(tuple, few)) == Counter(map(tuple, many))


def brute_interactions(rows, labels):
    good, toxic = ({k for k, *marks in labels if marks[n] == 1 and k is not None} for n in (0, 1))
    least = {}
    for k, _, t in rows:
        if k is not None:
            least[t or ""] = min(least.get(t or "", k), k)
    cells = Counter()
    for k, lang, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        upper = sum("A" <= c <= "Z" for c in t)
        fails = "".join(f for f, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * upper > 10 * len(t), any(c in "#$%&*|" for c in t), k is not None and k > least[t]), strict=True) if bad)
        cells[lang or "", fails, k in good, k in toxic] += 1
    out = {}
    for part in {c[0] for c in cells}:
        own = [(set(f), g, x, n) for (p, f, g, x), n in cells.items() if p == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                f, before = order[step - 1], set(order[: step - 1])
                removed = [c for c in own if f in c[0] and not c[0] & before]
                shapley[f] += sum(c[3] for c in removed)
                out[part, order, step] = [
                    sum(c[3] for c in own if not c[0] & (before | {f})), sum(c[3] for c in removed), sum(c[3] for c in own if f in c[0] and c[0] & before), sum(c[3] for c in own if c[0] == {f}),
                    sum(c[3] for c in removed if c[1]), sum(c[3] for c in removed if c[2]),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, None), (3, None, 1), (4, 0, 0), (7, 1, 1), (None, 1, 1), (-5, 1, 0)]


def made(rng, n):
    words = ["w%d" % k for k in range(150)]
    texts = [None, "", " ".join(words), " ".join(words[:99]), " ".join(words[:60] * 2), "ABC def " + " ".join(words), "a # b", " ".join(words) + " 5 % $", "É" * 500, "　 \x1c \x0b"]
    return [(rng.choice((None, *range(-8, 12))), rng.choice((None, "", "en", "de")), rng.choice(texts)) for _ in range(n)]


def write(spark, rows, path):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, lang string, text string, part string, n int")
    frame.coalesce(1).write.mode("append").parquet(path)


def test_interactions_of_odd_rows_file_by_file(spark, tmp_path):
    rng = random.Random(8)
    path, rows = str(tmp_path / "documents"), []
    for _ in range(6):
        part = made(rng, 60)
        write(spark, part, path)
        rows += part
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    check = lambda found: {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in found.collect()}
    for batches in (1, 3, 6):
        assert check(filter_audit.audit(spark, path, labels, batches=batches)) == brute_interactions(rows, LABELS)
    # new files, with smaller ids of known texts, retract what was counted
    folder = str(tmp_path / "state")
    filter_audit.update(spark, path, labels, folder, batches=2, buckets=8)
    more = [(-100 - k, "en", t) for k, (_, _, t) in enumerate(made(rng, 40))] + made(rng, 20)
    write(spark, more, path)
    found = filter_audit.interactions(filter_audit.update(spark, path, labels, folder, buckets=8))
    assert check(found) == brute_interactions(rows + more, LABELS)


def test_interactions_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    write(spark, [], path)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark, path, labels).count() == 0


def test_masks_as_sql_sees_them(spark):
    rng = random.Random(9)
    texts = [t or "" for _, _, t in made(rng, 30)]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.expr("length(t) - length(regexp_replace(t, '[A-Z]', ''))").alias("upper")).collect()
    for r in found:
        assert bool(filter_audit.mask_of(r["t"].encode()) & 4) == (100 * r["upper"] > 10 * len(r["t"]))
