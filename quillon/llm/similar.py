"""Documents of a word-shingle similarity of 0.8 or more: SimHash and Golay keys, then the rest.

Equal texts are one node from the start.  Links come by two ways, always by the exact
similarity of the sets of shingles:

* the near ones by operator 5: SimHash fingerprints of 64 bits, keys of Golay codewords
  (``near_dup.keys``).  Each node is tried against a member of its keys.  At a similarity of
  0.8 about 15 % of the bits differ, more than any such key can prove, so these keys find
  nearly all pairs above 0.95, but few at the threshold
* the others by shingles in one global order, rare ones first.  Of two sets similar enough,
  a common shingle is among the first of each.  The smaller set needs only the first
  n - 2s/(1+s) n (s the similarity), the larger the first n - s n, so a pair is a candidate
  where the one's short prefix meets the other's long one, and the places left for common
  shingles suffice

Before a pair's sets are compared, bitmaps and counts of their shingles by bucket bound what
they can have in common, so few whole sets are moved for nothing.

No link is wrong and none is missed, but for collisions of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialise, scratch
from quillon.llm.near_dup import contract, keyed, mixed, sampled, shared, shingle_hashes, simhash, stars

#: Most rounds of comparisons with one member of a key; they end once little is joined.
ROUNDS = 3
#: Common shingles come last in the global order: those that at least ``COMMON`` of one in
#: ``SETS`` sets have, the ``MOST`` commonest.  Any order gives the same links.
SETS, COMMON, MOST = 8, 2, 1 << 19
#: Bits of a set's bitmap, which bounds what it shares with others.
BITS = 1024


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted."""
    return np.unique(shingle_hashes(text, shingle))


def text_node() -> Column:
    """A text's number; null counts as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sets_of(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of ``texts`` (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 64) for at in range(0, batch.num_rows, 64)):
                sets = [shingle_set(t.as_py(), shingle) for t in part.column("text")]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("node"), lists], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, shingles array<bigint>")


def bucketed(found: np.ndarray) -> bytes:
    """How many hashes of a set fall into each bucket, by their low bits, at most 255; there is about a bucket for two."""
    n = max(64, 1 << (len(found) // 2).bit_length())
    return np.minimum(np.bincount((found & np.uint64(n - 1)).astype(np.int64), minlength=n), 255).astype(np.uint8).tobytes()


def most_common(a: bytes, b: bytes) -> int | None:
    """What two sets have in common at most; None where a bucket is full and so tells nothing."""
    x, y = (np.frombuffer(s, np.uint8) for s in (a, b))
    if max(x.max(), y.max()) == 255:
        return None
    n = min(len(x), len(y))
    return int(np.minimum(*(s.reshape(-1, n).sum(axis=0, dtype=np.int64) for s in (x, y))).sum())


def bitmap(found: np.ndarray) -> np.ndarray:
    """``BITS`` bits, by words of 64: which of as many buckets the hashes of a set fall into."""
    bits = np.zeros(BITS, np.uint8)
    bits[(found >> np.uint64(40) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, n, print, bits, buckets) of ``texts``: the number of distinct shingles, their SimHash, ``bitmap`` and ``bucketed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingle_set(t.as_py(), shingle) for t in batch.column("text"))
            found = [(len(s), simhash(s), bucketed(s), bitmap(s)) for s in sets]
            bits = pa.array([f[3] for f in found], pa.list_(pa.int64()))
            n, prints = (np.array([f[k] for f in found], t) for k, t in ((0, np.int64), (1, np.uint64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(n), pa.array(prints.view(np.int64)), bits, pa.array([f[2] for f in found], pa.binary())], names=["node", "n", "print", "bits", "buckets"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, n bigint, print bigint, bits array<bigint>, buckets binary")


def hopeful(pairs: DataFrame, nodes: DataFrame, permille: int) -> DataFrame:
    """The pairs (a, b, ra, rb) whose buckets allow the similarity."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    some = materialise(nodes.join(ends, "node", "left_semi").select("node", "n", "buckets"), "buckets")
    for end in ("a", "b"):
        pairs = pairs.join(some.toDF(end, f"n{end}", f"s{end}"), end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("sa", "sb", "na", "nb")]
            keep = [(c := most_common(x, y)) is None or c * (1000 + permille) >= (m + n) * permille for x, y, m, n in zip(*columns, strict=True)]
            yield batch.select(["a", "b", "ra", "rb"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a bigint, b bigint, ra bigint, rb bigint")


def common_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, sorted, and how many of a sample of the sets have them."""
    some = texts.filter(F.pmod(F.xxhash64("node"), F.lit(SETS)) == 0)
    found = sets_of(some, shingle).select(F.explode("shingles").alias("s")).groupBy("s").count()
    found = found.filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "s").limit(MOST).toArrow()
    values, counts = found.column("s").to_numpy(), found.column("count").to_numpy()
    order = np.argsort(values)
    return values[order], counts[order]


def prefixes(texts: DataFrame, shingle: int, permille: int) -> DataFrame:
    """(node, key, place): the first shingles of every set in the global order, as far as two nodes share them.

    ``place`` holds the set's size, the shingle's number in its order and whether it is of
    the short prefix: n << 32 | number << 1 | short.  A set without a shingle has the key 0.
    """
    values, counts = common_shingles(texts, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t_at in range(0, batch.num_rows, 256):
                part = batch.slice(t_at, 256)
                sets = [shingle_set(t.as_py(), shingle) for t in part.column("text")]
                sets = [s if len(s) else np.zeros(1, np.uint64) for s in sets]
                own, n = part.column("node").to_numpy(), np.fromiter(map(len, sets), np.int64, len(sets))
                every = np.concatenate(sets).view(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                rank = np.zeros(len(every), np.int64)
                if len(values):
                    at = np.minimum(np.searchsorted(values, every), len(values) - 1)
                    rank = np.where(values[at] == every, counts[at], 0)
                every = every[np.lexsort((every, rank, row))]
                number = np.arange(len(every)) - np.repeat(np.cumsum(n) - n, n)
                long, short = (n - -(-n * of // to) for of, to in ((permille, 1000), (2 * permille, 1000 + permille)))
                keep = np.flatnonzero(number <= long[row])
                row, number = row[keep], number[keep]
                place = n[row] << 32 | number << 1 | (number <= short[row])
                yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(every[keep]), pa.array(place)], names=["node", "key", "place"])

    every = lambda t: t.select("node", "text").mapInArrow(run, "node bigint, key bigint, place bigint")
    return shared(every(texts), every(sampled(texts, "node")), "node", F.col("place") % 2 == 1)


def size(place: Column) -> Column:
    return F.shiftright(place, 32)


def number(place: Column) -> Column:
    return F.shiftright(place.bitwiseAND((1 << 32) - 1), 1)


def overlap(na: Column, nb: Column, permille: int) -> Column:
    """The least number of common shingles of similar sets of these sizes."""
    return F.ceil((na + nb) * permille / (1000 + permille))


def room(na: Column, nb: Column, a: Column, b: Column, permille: int) -> Column:
    """Whether sets with these bitmaps can be similar: each bucket that only one has is a
    shingle that the other lacks."""
    lacks = lambda x, y: sum((F.bit_count(F.get(x, F.lit(k)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(k))))) for k in range(BITS // 64)), F.lit(0))
    least = overlap(na, nb, permille)
    return (na - lacks(a, b) >= least) & (nb - lacks(b, a) >= least)


def fits(a: Column, b: Column, permille: int) -> Column:
    """Whether sets that meet at these places, ``a`` in its short prefix and not the larger,
    can have enough shingles in common from there on."""
    na, nb = size(a), size(b)
    least = overlap(na, nb, permille)
    return (a % 2 == 1) & (na <= nb) & (na * 1000 >= nb * permille) & (F.least(na - number(a), nb - number(b)) >= least)


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, permille: int) -> DataFrame:
    """The pairs (a, b, ra, rb) of nodes whose sets are similar enough, as links (a, b) of their roots."""
    pairs = materialise(pairs.select("a", "b", "ra", "rb").distinct(), "candidates")
    pairs = materialise(hopeful(pairs, nodes, permille), "hopeful")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = materialise(sets_of(texts.join(ends, "node", "left_semi"), shingle), "sets")
    for end in ("a", "b"):
        pairs = pairs.join(sets.toDF(end, f"s{end}"), end)
    pairs = pairs.withColumn("common", F.size(F.array_intersect("sa", "sb")))
    # in whole numbers, so that a similarity of exactly the threshold links; no shingles are alike
    alike = F.col("common") * 1000 >= (F.size("sa") + F.size("sb") - F.col("common")) * permille
    return materialise(pairs.filter(alike).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "similar")


def linked(texts: DataFrame, shingle: int, permille: int) -> DataFrame:
    """(node, root) of ``texts`` (node, text), distinct: the smallest node that links reach."""
    ends = [F.col("node").alias("a"), F.col("m.node").alias("b"), F.col("root").alias("ra"), F.col("m.root").alias("rb")]
    nodes = materialise(sketches(texts, shingle), "sketches")
    roots = nodes.select("node", F.col("node").alias("root"))
    # sets with equal fingerprints have the same keys, which may be only theirs
    one = nodes.groupBy("print").agg(F.min("node").alias("node"), F.count("*").alias("copies"))
    held = keyed(one.select("print")).join(nodes, "print")
    equal = nodes.join(one.filter("copies > 1").select("print"), "print", "left_semi").withColumn("key", F.col("print").bitwiseOR(F.lit(-(1 << 63))))
    held = materialise(held.select("node", "n", "print", "key").unionAll(equal.select("node", "n", "print", "key")), "keyed")
    for k in range(2):
        pairs = stars(held.join(roots, "node") if k else held.withColumn("root", F.col("node")), k, "n", "print")
        pairs = pairs.filter(F.least("n", "m.n") * 1000 >= F.greatest("n", "m.n") * permille)
        # every node is tried against the closest of its keys' members
        bits = F.bit_count(F.col("print").bitwiseXOR(F.col("m.print")))
        best = pairs.groupBy("node").agg(F.min_by(F.struct("root", "m"), F.struct(bits, "m.node")).alias("p")).select("node", "p.root", "p.m")
        links = verified(best.select(*ends), nodes, texts, shingle, permille)
        if links.isEmpty():
            break
        roots = contract(roots, links)
    held = materialise(prefixes(texts, shingle, permille), "prefixes")
    for k in range(ROUNDS):
        rows = mixed(held.join(roots, "node"))
        # where the key comes early in its order, a set has little of its own: such members are
        # similar to most others, first of all, then outside the largest component
        early = (number(F.col("place")) / size(F.col("place")),)
        pairs = stars(rows, k, "place", first=(early, (~F.col("stranger"), *early), ())[k % 3]).filter(fits(F.col("place"), F.col("m.place"), permille) | fits(F.col("m.place"), F.col("place"), permille))
        # every node is tried against the member that most of its keys have
        best = pairs.groupBy(*ends).count().groupBy("a").agg(F.max_by(F.struct("b", "ra", "rb"), F.struct("count", "b")).alias("p"), F.count("*").alias("n")).select("a", "p.*")
        links = verified(best, nodes, texts, shingle, permille)
        if links.isEmpty():
            break
        roots = contract(roots, links)
    # all that share a key and aren't joined yet
    rows = materialise(mixed(held.join(roots, "node")).join(nodes.select("node", "bits"), "node"), "mixed")
    other = rows.toDF(*(f"{c}2" if c != "key" else c for c in rows.columns))
    pairs = rows.filter("stranger").join(other, "key").filter((F.col("root") != F.col("root2")) & (fits(F.col("place"), F.col("place2"), permille) | fits(F.col("place2"), F.col("place"), permille)))
    pairs = pairs.filter(room(size(F.col("place")), size(F.col("place2")), F.col("bits"), F.col("bits2"), permille))
    pairs = pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"), F.least("root", "root2").alias("ra"), F.greatest("root", "root2").alias("rb"))
    links = verified(pairs, nodes, texts, shingle, permille)
    return roots if links.isEmpty() else contract(roots, links)


def numbered(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, text, node) of the rows with a key, and (node, least key) of the distinct texts."""
    rows = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text")).filter(F.col("key").isNotNull())
    rows = rows.withColumn("node", text_node())
    return rows, rows.groupBy("node").agg(F.min("key").alias("least"))


def _roots(docs: DataFrame, shingle: int, similarity: float, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(node, least, root) of the distinct texts, and the rows (key, text, node)."""
    if not 0.8 <= similarity <= 1:
        raise ValueError("the prefixes are meant for similarities of 0.8 or more")
    with scratch() as kept:
        rows, nodes = numbered(docs, key, text)
        nodes = materialise(nodes, "nodes")
        # one row of each text; equal texts may have the same key
        texts = rows.join(nodes.select("node", F.col("least").alias("key")), ["node", "key"], "left_semi").select("node", "text").dropDuplicates(["node"])
        texts = materialise(texts, "texts")
        out = materialise(nodes.join(linked(texts, shingle, round(similarity * 1000)), "node"), "groups")
        kept.append(out)
    return out, rows


def groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs`` that has a ``key``: ``key`` and component_id, the smallest ``key`` that links reach.

    Two rows link if their sets of word shingles have a Jaccard similarity of ``similarity``
    (at least 0.8) or more.  Null texts count as empty; all texts without a word are alike;
    repeated rows stay; an empty table gives an empty result; other columns don't take part.
    """
    found, rows = _roots(docs, shingle, similarity, key, text)
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    # a frequent root or text is split by adaptive execution
    ids = materialise(found.join(materialise(least, "least"), "root").select("node", "component_id"), "ids")
    return rows.join(ids, "node").select(F.col("key").alias(key), "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first (by ``key``, then by the text's hash) of their group, all columns.

    Of rows with the same ``key`` and text one stays; different texts with one ``key`` are
    different documents; rows without a key all stay.  Nulls and empty tables as in ``groups``.
    """
    found, _ = _roots(docs, shingle, similarity, key, text)
    # the least of a group comes by an aggregate, so that no group is one task's
    first = found.groupBy("root").agg(F.min(F.struct("least", "node")).alias("f")).select(F.col("f.least").alias("__least"), F.col("f.node").alias("__first"))
    first = materialise(first, "kept")
    rows = docs.withColumn("__node", F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    rows = rows.join(first, (F.col("__node") == F.col("__first")) & (F.col(f"`{key}`") == F.col("__least")), "left_semi").dropDuplicates(["__node", key])
    return rows.drop("__node").unionAll(docs.filter(F.col(f"`{key}`").isNull()))
