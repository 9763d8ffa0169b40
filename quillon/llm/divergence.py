"""How the sources of a language differ in their words.

A task gathers texts into a shard: the bytes of an Arrow buffer, in which a pointer stands
at the start of every word.  The pointers are sorted by the suffixes they point to, up to
the word's end, with multikey quicksort: a slice of pointers is parted into those whose
next eight bytes are below, equal to and above a pivot's; the equal ones go on with the
eight bytes after.  Short slices are sorted at once.  What ends equal is a run, one term:
its length by document and source are the term's counts, as parting keeps the order of
documents.  A shard emits one row per term, language and source, which Spark adds up.

From there on everything is whole numbers in Spark: terms that enough documents of a
language hold, their smoothed share in each source, and the distance of every two sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialise

#: Bytes of text that are sorted together; a longer text is a shard of its own.
SHARD = 16 << 20
#: Slices up to this length are sorted at once.
SHORT = 1 << 15
#: Least number of blocks that share the terms of a language when sources are compared, and rows to a block beyond.
BLOCKS, BLOCK_ROWS = 64, 100_000
#: Words are runs of letters A to Z and of what lies beyond ASCII; all bytes of such characters are 128 or more.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Keeps the first k of eight bytes.
_FIRST = np.array([(0xFFFFFFFFFFFFFFFF << (8 * (8 - k))) & 0xFFFFFFFFFFFFFFFF for k in range(9)], np.uint64)


class Shard:
    """Words of a buffer of texts; ``starts`` holds where each text begins, and the end."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        inside = WORD_BYTE[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        at = starts[:-1][starts[:-1] < len(data)]  # texts that aren't empty begin a word or none
        first[at] |= inside[at]
        ends = starts[1:][starts[1:] > 0] - 1
        last[ends] |= inside[ends]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bytes = np.zeros(len(data) + 8, np.uint8)
        np.take(LOWER, data, out=self.bytes[: len(data)])
        self.document = np.searchsorted(starts, self.begin, side="right") - 1
        self.eight = np.ndarray((len(data) + 1,), ">u8", self.bytes, strides=(1,))

    def _keys(self, words: np.ndarray, depth: int) -> np.ndarray:
        """The eight bytes of each word from ``depth`` on, zeros after its end."""
        at, left = self.begin[words] + depth, self.end[words] - self.begin[words] - depth
        return self.eight[np.minimum(at, len(self.eight) - 1)].astype(np.uint64) & _FIRST[np.clip(left, 0, 8)]

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' numbers in order of their bytes, and where each run of equal ones begins."""
        out, runs, at = np.empty(len(self.begin), np.int64), [], 0
        every = np.arange(len(self.begin))
        todo = [(every, self._keys(every, 0), 0)] if len(every) else []
        while todo:
            words, keys, depth = todo.pop()
            if depth >= 0 and len(words) <= SHORT:
                out[at : at + len(words)], cuts = self._short(words, keys, depth)
                runs.append(at + cuts)
                at += len(words)
                continue
            if depth < 0:  # equal to the end
                out[at : at + len(words)] = words
                runs.append(np.array([at]))
                at += len(words)
                continue
            few = np.sort(keys[:: max(1, len(keys) // 63)])
            pivot = few[len(few) // 2]
            same, below = keys == pivot, keys < pivot
            above = ~(same | below)
            equal = words[same]
            if above.any():
                todo.append((words[above], keys[above], depth))
            ended = pivot & np.uint64(255) == 0
            todo.append((equal, keys[same], -1) if ended else (equal, self._keys(equal, depth + 8), depth + 8))
            if below.any():
                todo.append((words[below], keys[below], depth))
        return out, np.concatenate(runs) if runs else np.empty(0, np.int64)

    def _short(self, words: np.ndarray, keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorts a short slice at once: all its groups of equal words go on with their next eight bytes together."""
        order = np.argsort(keys, kind="stable")
        words, keys = words[order], keys[order]
        fresh = np.ones(len(words), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        open_ = np.flatnonzero(keys & np.uint64(255))  # not at their ends yet
        while True:
            alone = fresh[open_] & np.append(fresh, True)[open_ + 1]
            open_ = open_[~alone]
            if not len(open_):
                return words, np.flatnonzero(fresh)
            depth += 8
            group = np.cumsum(fresh)[open_]
            next_ = self._keys(words[open_], depth)
            order = np.lexsort((next_, group))
            words[open_], next_ = words[open_[order]], next_[order]
            fresh[open_[1:]] |= (next_[1:] != next_[:-1]) | (group[1:] != group[:-1])
            open_ = open_[(next_ & np.uint64(255)) != 0]

    def counts(self, group: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Per run and group that occurs in it: the term, the group, documents and occurrences.

        ``group`` holds a number for each text.
        """
        order, runs = self.sort()
        run = np.zeros(len(order), np.int64)
        run[runs] = 1
        run = np.cumsum(run) - 1
        document = self.document[order]
        fresh = np.ones(len(order), bool)  # first of its document in the run
        fresh[1:] = (document[1:] != document[:-1]) | (run[1:] != run[:-1])
        width = int(group.max()) + 1 if len(group) else 1
        keys, where = np.unique(run * width + group[document], return_inverse=True)
        n_docs, n = np.bincount(where[fresh], minlength=len(keys)), np.bincount(where, minlength=len(keys))
        chosen = order[runs[keys // width]]
        raw = self.bytes.tobytes()
        terms = [raw[a:b] for a, b in zip(self.begin[chosen].tolist(), self.end[chosen].tolist(), strict=True)]
        return terms, keys % width, n_docs, n


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            held.append(part)
            n += pc.sum(pc.binary_length(part.column(2))).as_py() or 0
            if n >= size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", shard: int = SHARD) -> DataFrame:
    """lang, source, term, n_docs and n: in how many texts of the group the term is, and how often.

    Nulls count as empty strings.  A term is a run of letters A to Z (lower-cased) and
    characters beyond ASCII.  Every row is a document of its own, repeated ones too.
    """
    source_ = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _shards(batches, shard):
            texts = table.column("text").cast(pa.large_binary()).combine_chunks()
            if isinstance(texts, pa.ChunkedArray):
                texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.large_binary())
            starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2], np.uint8)[starts[0] : starts[-1]] if texts.buffers()[2] else np.empty(0, np.uint8)
            groups = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in ("lang", "source")], names=["lang", "source"])
            names: dict[tuple[str, str], int] = {}
            number = np.array([names.setdefault((g["lang"], g["source"]), len(names)) for g in groups.to_pylist()], np.int64)
            terms, group, n_docs, n = Shard(data, starts - starts[0]).counts(number)
            known = list(names)
            languages, sources = (pa.array([g[k] for g in known], pa.string()) for k in (0, 1))
            for a in range(0, len(terms), 50_000):
                z = a + 50_000
                at = pa.array(group[a:z])
                yield pa.RecordBatch.from_arrays([languages.take(at), sources.take(at), pa.array(terms[a:z], pa.binary()).cast(pa.string()), pa.array(n_docs[a:z], pa.int64()), pa.array(n[a:z], pa.int64())], names=["lang", "source", "term", "n_docs", "n"])

    parts = source_.mapInArrow(run, "lang string, source string, term string, n_docs bigint, n bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))


def _share(n: Column, total: Column, kept: Column, smooth: int) -> Column:
    """1 + floor(10^9 * (n + smooth) / (total + smooth * kept)), in whole numbers."""
    above = (n.cast("decimal(20,0)") + F.lit(smooth).cast("decimal(4,0)")) * F.lit(1_000_000_000).cast("decimal(10,0)")
    below = total.cast("decimal(20,0)") + F.lit(smooth).cast("decimal(4,0)") * kept.cast("decimal(18,0)")
    return F.lit(1) + F.call_function("div", above, below)


def audit(docs: DataFrame, least_docs: int = 30, smooth: int = 5, top: int = 50, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Compares the sources of each language by the terms they use.

    Every language keeps the terms that at least ``least_docs`` of its documents hold; in
    each of its sources, and in the language as a whole, a kept term has the share
    p = 1 + floor(10^9 (n + smooth) / (N + smooth V)), n its occurrences there (0 counts),
    N the sum of n, V the number of kept terms.  Returns lang, source, part, item, value,
    rank:

    * part ``pair``: item is another source of the language, value the sum over all kept
      terms of the two shares' distance; all of them, ranked by value
    * part ``term``: item is a kept term that occurs in the source and has a larger share
      there than in the language, value the difference; the first ``top`` of them

    Ranks count from 1 in each group and part, by value falling, then by item in order of
    its bytes.  A null text, language or source counts as empty; a source without a kept
    term still has its pairs (0 where the language keeps none); a language with one source
    has no pairs; an empty table gives an empty result.

    The result holds a row for every two sources of a language, so their number, not that
    of documents or terms, bounds what a task holds of them.
    """
    counts = materialise(term_counts(docs, lang, source, text), "terms")
    groups = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source")))).distinct()
    kept = counts.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n_lang")).filter(F.col("n_docs") >= least_docs)
    kept = kept.drop("n_docs")
    cells = materialise(counts.select("lang", "term", "source", "n").join(kept, ["lang", "term"]), "cells")
    of_lang = cells.groupBy("lang", "term").agg(F.first("n_lang").alias("n_lang")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n_lang").alias("total_lang"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = materialise(groups.join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kept", "total_lang"))), "sizes")
    ranked = lambda rows, part: rows.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    )
    pairs = ranked(_distances(cells, sizes, smooth), "pair")
    shares = cells.join(sizes, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), (_share(F.col("n"), F.col("total"), F.col("kept"), smooth) - _share(F.col("n_lang"), F.col("total_lang"), F.col("kept"), smooth)).alias("value")
    )
    terms = ranked(shares.filter("value > 0"), "term").filter(F.col("rank") <= top)
    return pairs.unionByName(terms)


def _distances(cells: DataFrame, sizes: DataFrame, smooth: int) -> DataFrame:
    """lang, source, item, value for every two sources of a language, both ways.

    The terms of a language are dealt into blocks.  A block fills a matrix of shares, a
    row for each term in hand and a column for each source, and adds up the distances of
    its columns; the blocks' sums are added in Spark.
    """
    block = F.pmod(F.xxhash64("term"), F.lit(max(BLOCKS, cells.count() // BLOCK_ROWS))).cast("int")
    left = cells.select("lang", block.alias("block"), "term", "source", "n")
    # a language without kept terms has one empty block
    blocks = left.select("lang", "block").distinct()
    right = sizes.join(blocks, "lang", "left").select("lang", F.coalesce("block", F.lit(0)).alias("block"), "source", "total", "kept")

    def run(key: tuple, own: pa.Table, all_: pa.Table) -> pa.Table:
        order = pc.sort_indices(all_.column("source"))
        names, total = all_.column("source").take(order), all_.column("total").take(order).to_numpy()
        below = total.astype(object) + smooth * int(all_.column("kept")[0].as_py())
        none = np.array([1 + 10**9 * smooth // b if b else 1 for b in below], np.int64)
        sums = np.zeros((len(none), len(none)), np.int64)
        if own.num_rows:
            row = pc.dictionary_encode(own.column("term")).combine_chunks().indices.to_numpy()
            column = pc.index_in(own.column("source"), value_set=names.combine_chunks()).to_numpy()
            n = own.column("n").to_numpy()
            exact = [1 + 10**9 * (int(k) + smooth) // int(b) for k, b in zip(n.tolist(), below[column], strict=True)]
            share, order = np.array(exact, np.int64), np.argsort(row, kind="stable")
            row, column, share = row[order], column[order], share[order]
            step = max(1, 4_000_000 // len(none))
            for a in range(0, int(row[-1]) + 1, step):
                lo, hi = np.searchsorted(row, (a, a + step))
                matrix = np.repeat(none[:, None], min(step, int(row[-1]) + 1 - a), axis=1)
                matrix[column[lo:hi], row[lo:hi] - a] = share[lo:hi]
                for k in range(len(none) - 1):
                    sums[k, k + 1 :] += np.abs(matrix[k + 1 :] - matrix[k]).sum(axis=1)
        sums += sums.T
        a, b = np.nonzero(~np.eye(len(none), dtype=bool))
        lang = pa.array([key[0].as_py()] * len(a), pa.string())
        return pa.table({"lang": lang, "source": names.take(pa.array(a)), "item": names.take(pa.array(b)), "value": pa.array(sums[a, b])})

    parts = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(run, "lang string, source string, item string, value bigint")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
