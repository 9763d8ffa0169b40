"""Near-duplicate documents: SimHash fingerprints joined by Golay-code fuzzy hashing.

Fingerprints within four bits are linked, and linked documents form components.  A
fingerprint is cut into three segments, each a word of the perfect binary Golay code
(23 bits, 12 of them information) with zeros in front.  Every word lies within 3 bits of
exactly one codeword, the nearest; up to 5 others lie at 4 bits and up to 21 at 5.  So of
two words

* that are equal, the nearest codeword is the same
* at distance 1, the nearest of either is within 4 of the other
* at distance 2, a word between them has its nearest codeword within 4 of both
* at distance 3, some codeword is within 4 of the one and 5 of the other
* at distance 4, some codeword is within 5 of both

A key holds one codeword's index of each segment, 36 bits.  Four differing bits fall on the
segments as 4; 3 and 1; 2 and 2; or 2, 1 and 1, so it is enough to make keys of the nearest
codewords with one of them exchanged for any within 5, or two for any within 4: 139 at most
(where two segments differ by one bit, the one fingerprint takes its own nearest codeword in
the first and the other's in the second, and the other the same two from its side).  Any
two linked fingerprints share a key; two random ones do with a chance of 2e-7.  What shares
a key is verified bit by bit.

Equal fingerprints are one class from the start.  Within a key, members are first compared
with one member of it, and joined components are contracted before members of *different*
components that share a key are compared, so a large group of copies never yields its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialise, scratch

#: Fixed value: generator polynomial of the Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
SEED = 42
#: Lowest bit and number of bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
ROUNDS = 3
#: Keys that many fingerprints have are looked for among one of so many, and at most so many
#: are told to all tasks.  This only spreads the work; no result depends on it.
SAMPLE, HOT = 64, 4096
#: Fingerprints in a task that makes their keys.
PRINTS = 20_000


@cache
def golay() -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Nearest codeword's index of every 23-bit word, its error's number, and for 4 and 5
    bits as CSR by error the differences to the indices of the codewords that far away.

    Indices are linear: the index of a sum of codewords is the sum of the indices.
    """
    code = np.zeros(4096, np.int64)
    for bit in range(12):
        code ^= np.where(np.arange(4096) >> bit & 1, GOLAY << bit, 0)
    ones = [1 << b for b in range(23)]
    errors = [sum(c) for w in range(4) for c in combinations(ones, w)]
    index, error = np.zeros(1 << 23, np.int16), np.zeros(1 << 23, np.int16)
    for k, e in enumerate(errors):
        index[code ^ e] = np.arange(4096)
        error[code ^ e] = k
    away = np.bitwise_count(np.array(errors)[:, None] ^ code[None, :])
    far = []
    for d in (4, 5):
        which, other = np.nonzero(away == d)
        far.append((np.concatenate(([0], np.cumsum(np.bincount(which, minlength=len(errors))))), other))
    return index, error, far


def _picked(ends: np.ndarray, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all values in the CSR lists of ``at``."""
    counts = ends[at + 1] - ends[at]
    row = np.repeat(np.arange(len(at)), counts)
    return row, values[np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(ends[at], counts)]


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of every fingerprint, each once."""
    index, error, far = golay()
    prints = prints.astype(np.uint64)
    words = [(prints >> np.uint64(low) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]
    base = sum(index[w].astype(np.int64) << 12 * s for s, w in enumerate(words))
    rows, out = [np.arange(len(prints))], [base]
    near = []  # per segment and row its codewords at 4 bits
    for s, w in enumerate(words):
        for k, (ends, values) in enumerate(far):
            row, change = _picked(ends, values, error[w].astype(np.int64))
            rows.append(row)
            out.append(base[row] ^ change << 12 * s)
            if k == 0:
                near.append((row, change << 12 * s))
    for (row, change), (other, more) in combinations(near, 2):
        # all pairs of the two segments' changes of a row
        counts = np.bincount(other, minlength=len(prints))
        ends = np.concatenate(([0], np.cumsum(counts)))
        at, second = _picked(ends, more, row)
        rows.append(row[at])
        out.append(base[row[at]] ^ change[at] ^ second)
    return np.concatenate(rows), np.concatenate(out)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of the word shingles, with repeats; fewer words are one shingle, no word none."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    line, hash_ = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hash_(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: 1 - shingle or None].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.fromiter((hash_(line[a:b], SEED) for a, b in spans), np.uint64, len(words) - shingle + 1)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; zero for none."""
    total, n = np.zeros(64, np.int64), len(hashes)
    for block in np.array_split(hashes.astype("<u8"), 1 + n // 65536):
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and fingerprint (bigint, the 64 bits as two's complement) of every row.

    Null and empty texts, and texts without a word, have fingerprint zero.
    """
    source = docs.select(docs[key].alias("__key"), docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash(shingle_hashes(t.as_py(), shingle)) for t in batch.column("__text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(found.view(np.int64))], names=[key, "fingerprint"])

    return source.mapInArrow(run, f"`{key}` {source.schema['__key'].dataType.simpleString()}, fingerprint bigint")


def keyed(nodes: DataFrame) -> DataFrame:
    """(print, key) of the fingerprints in column ``print``: the keys that two of them have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 2048) for at in range(0, batch.num_rows, 2048)):
                own = part.column("print").to_numpy()
                row, key = keys(own.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(key)], names=["print", "key"])

    # a row becomes over a hundred, so the few bytes of a node are dealt to many tasks first
    nodes = nodes.select("print").repartition(max(1, -(-nodes.count() // PRINTS)))
    every = lambda prints: prints.mapInArrow(run, "print bigint, key bigint")
    return shared(every(nodes), every(sampled(nodes, "print")), "print")


def sampled(nodes: DataFrame, node: str) -> DataFrame:
    return nodes.filter(F.pmod(F.xxhash64(node, F.lit(SAMPLE)), F.lit(SAMPLE)) == 0)


def shared(rows: DataFrame, sample: DataFrame, node: str, use: Column | None = None) -> DataFrame:
    """The rows whose key two nodes have and, with ``use``, for one of which it holds.

    ``sample`` holds the rows of some nodes.  Keys that are frequent there are surely shared,
    so their rows are dealt out by node as well, where one key would fill one task.
    """
    hot = sample.groupBy("key").agg(F.count("*").alias("n"), *([] if use is None else [F.max(use).alias("u")])).filter(F.col("n") >= 8)
    hot = materialise((hot if use is None else hot.filter("u")).orderBy(F.desc("n"), "key").select("key").limit(HOT), "hot")
    found = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), "key", "left")
    found = found.withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(node), F.lit(256))).otherwise(0))
    w = Window.partitionBy("key", "__salt")
    found = found.withColumns({"__least": F.min(node).over(w), "__most": F.max(node).over(w), "__use": F.lit(True) if use is None else F.max(use).over(w)})
    return found.filter(F.col("__hot") | ((F.col("__least") != F.col("__most")) & F.col("__use"))).select(*rows.columns)


def close(a: Column, b: Column, bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= bits


def components(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes in ``links`` (a, b): the smallest node that they reach.

    Every round hooks each root onto the smallest root next to it and halves the paths;
    the rounds grow with the logarithm of a component's width.
    """
    near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    near = materialise(near, "links")
    roots = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
    roots = roots.select("node", F.col("node").alias("root"))
    while not near.isEmpty():
        hooks = materialise(near.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("up")), "hooks")
        # a hook leads to a smaller root, so hooks form trees; two steps up a round
        twice = hooks.join(hooks.select(F.col("root").alias("up"), F.col("up").alias("top")), "up", "left").select("root", F.coalesce("top", "up").alias("up"))
        roots = materialise(moved(roots, twice.select("root", F.col("up").alias("top"))), "roots")
        ends = roots.select("node", "root")
        near = near.join(ends.toDF("a", "ra"), "a").join(ends.toDF("b", "rb"), "b").filter("ra != rb")
        near = materialise(near.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "links")
    return roots


def moved(roots: DataFrame, top: DataFrame) -> DataFrame:
    """``roots`` (node, root) after its roots went to ``top`` (root, top)."""
    return roots.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def contract(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after links (a, b) of roots joined them."""
    top = components(links).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return materialise(moved(roots, top), "roots")


def mixed(held: DataFrame) -> DataFrame:
    """The rows (key, root, ...) whose key different components have; the others are done.

    Adds ``stranger``: the row isn't of the component that has most of the key's rows.  Two
    rows of different components are never both of it, so it is enough to compare strangers
    with all.
    """
    counts = held.groupBy("key", "root").agg(F.count("*").alias("n"))
    major = counts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.count("*").alias("roots")).filter("roots > 1")
    major = materialise(major.select("key", "major"), "major")
    return held.join(major, "key").withColumn("stranger", F.col("root") != F.col("major")).drop("major")


def stars(held: DataFrame, k: int, *more: str, first: tuple[Column, ...] = ()) -> DataFrame:
    """Rows (key, node, root, ...) with the key's member ``m`` (node, root, ...), the first by
    ``first`` and a hash that changes with the round ``k``, where it is of another component."""
    middle = held.groupBy("key").agg(F.min_by(F.struct("node", "root", *more), F.struct(*first, F.xxhash64("node", F.lit(k)), "node")).alias("m"))
    return held.join(materialise(middle, "middles"), "key").filter(F.col("root") != F.col("m.root"))


def classes(nodes: DataFrame, bits: int = 4) -> DataFrame:
    """(print, root) for ``nodes`` (node, print), distinct fingerprints with a node each: the
    smallest node that links of at most ``bits`` differing bits reach."""
    if not 0 <= bits <= 4:
        raise ValueError("the keys cover links of at most four bits")
    with scratch() as kept:
        held = materialise(keyed(nodes), "keyed")
        roots = nodes.select("node", F.col("node").alias("root"))
        held = materialise(held.join(nodes, "print"), "keyed")
        for k in range(ROUNDS):
            rows = held.join(roots, "node") if k else held.withColumn("root", F.col("node"))
            links = stars(rows, k, "print").filter(close(F.col("print"), F.col("m.print"), bits))
            links = materialise(links.select(F.col("root").alias("a"), F.col("m.root").alias("b")).distinct(), "stars")
            if links.isEmpty():
                break
            roots = contract(roots, links)
        # what shares a key and isn't joined yet
        rows = materialise(mixed(held.join(roots, "node")), "mixed")
        other = rows.toDF(*(f"{c}2" if c != "key" else c for c in rows.columns))
        links = rows.filter("stranger").join(other, "key").filter((F.col("root") != F.col("root2")) & close(F.col("print"), F.col("print2"), bits))
        links = materialise(links.select(F.col("root").alias("a"), F.col("root2").alias("b")).distinct(), "links")
        if not links.isEmpty():
            roots = contract(roots, links)
        out = materialise(nodes.join(roots, "node").select("print", "root"), "classes")
        kept.append(out)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs`` ``key``, fingerprint (bigint) and component_id.

    component_id is the smallest ``key`` that links reach.  Null texts count as empty; all
    texts without a word have fingerprint zero and link to each other; repeated rows stay.
    Rows without a ``key`` stay but link nothing: their component_id is that of the rows
    with the same fingerprint, null if there are none.  An empty table gives an empty
    result; other columns don't take part.
    """
    with scratch() as kept:
        prints = materialise(fingerprints(docs, shingle, key, text), "fingerprints")
        nodes = prints.filter(F.col(key).isNotNull()).groupBy(F.col("fingerprint").alias("print")).agg(F.min(key).alias("node"))
        roots = classes(materialise(nodes, "prints"), bits)
        kept += [prints, roots]
    # one row for each distinct fingerprint; a frequent one is split by adaptive execution
    found = prints.join(roots.withColumnsRenamed({"print": "fingerprint", "root": "component_id"}), "fingerprint", "left")
    return found.select(key, "fingerprint", "component_id")
