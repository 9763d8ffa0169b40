"""Best-fit packing of token pieces into sequences by minimum bin slack.

A bin is opened with the longest piece left; a subset-sum over the lengths that are left,
with the reachable sums as bits of one integer, finds the fullest combination that fits
beside it, and these pieces are removed.  What a bin needs to know of the pieces is only
how many there are of each length, so the bins are planned on a table of at most
``size`` counts, however many rows there are, and equal bins in a row are planned as one
pattern.  Spark numbers the pieces within each length, in groups of a bounded size, and
every piece looks up its place: no row passes through the driver, and no length's rows
through one task.

* null texts count as empty, a document always has its end token, so every row of the
  input has at least one piece
* documents longer than ``size`` are cut; all pieces but the first are full
* repeated rows are packed as often as they occur; an empty table gives no rows
* columns of the input that are not asked for don't take part, whatever their names
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.bpe import ids_of
from quillon.llm.common import extended, materialise

#: Pieces of one length that are numbered in one group.
GROUP = 100_000


def pieces(docs: DataFrame, path: str, size: int = 1024, eos: int = 2, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Cuts documents: ``key``, piece, start, length, ids_crc32 and, if asked for, ids."""
    source = docs.select(docs[key].alias("__key"), docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                rows = batch.slice(begin, 256)
                at, piece, start, crc, parts = [], [], [], [], []
                for row, value in enumerate(rows.column("__text")):
                    all_ids = np.append(encode(value.as_py() or ""), eos).astype("<u4")
                    first = len(all_ids) % size or size
                    for k, part in enumerate(np.split(all_ids, range(first, len(all_ids), size))):
                        at.append(row)
                        piece.append(k)
                        start.append(0 if k == 0 else first + (k - 1) * size)
                        crc.append(zlib.crc32(part.tobytes()))
                        parts.append(part)
                out = [
                    rows.column("__key").take(pa.array(at, pa.int32())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(map(len, parts), pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                if ids:
                    out.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=[key, "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    kind = source.schema["__key"].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * ids)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The combination of available lengths with the largest sum up to ``room``."""
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for length in sorted((n for n, k in counts.items() if k and n <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left:
            times = min(times, left)
            steps.append((reach, length, times))
            reach |= (reach << (length * times)) & full
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    out, goal = [], reach.bit_length() - 1
    for before, length, times in reversed(steps):
        if not before >> goal & 1:
            out += [length] * times
            goal -= length * times
    return out


def plan(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Patterns of bins, each with the number of times it is used, by minimum bin slack."""
    left, out = {n: k for n, k in counts.items() if k}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        bin_ = [longest, *fullest(left, size - longest)]
        left[longest] += 1
        need = {n: bin_.count(n) for n in bin_}
        times = min(left[n] // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((times, bin_))
    return out


def _places(patterns: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """For each length rows (first number, first sequence, pieces a sequence, offset)."""
    numbered: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for times, bin_ in patterns:
        offset = 0
        for n in sorted(set(bin_), reverse=True):
            k = bin_.count(n)
            rows.setdefault(n, []).append((numbered.get(n, 0), sequence, k, offset))
            numbered[n] = numbered.get(n, 0) + k * times
            offset += n * k
        sequence += times
    return {n: np.array(x, np.int64) for n, x in rows.items()}


def pack(cut: DataFrame, size: int = 1024, key: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to the rows of ``pieces``.

    The cut pieces are written to the shared folder first, as they are read again: for the
    counts of each length and to be placed.  With them goes a number that deals the pieces
    of one length to groups of about ``GROUP``, also where rows are equal.  Full pieces need
    no number of their own: each is a sequence.
    """
    cut = materialise(cut.withColumn("__deal", F.monotonically_increasing_id()), "pieces")
    names = [c for c in cut.columns if c != "__deal"]
    part = cut.filter(F.col("length") < size)
    sizes = {r[0]: r[1] for r in part.groupBy("length").count().collect()}  # a row for each length
    groups = np.array([1 + sizes.get(n, 0) // GROUP for n in range(size)], np.int64)
    often = {n: int(k) for n, k in enumerate(groups) if k > 1}
    n_groups = F.coalesce(F.create_map(*(F.lit(x) for kv in often.items() for x in kv))[F.col("length")], F.lit(1)) if often else F.lit(1)
    salted = part.withColumn("__salt", F.pmod(F.xxhash64("__deal"), n_groups).cast("int"))
    # a row for each length and for every GROUP pieces
    found = sorted(tuple(r) for r in salted.groupBy("length", "__salt").count().collect())
    base, counts = np.concatenate(([0], np.cumsum(groups))), {}
    first = np.zeros(base[-1], np.int64)
    for n, s, k in found:
        first[base[n] + s] = counts.get(n, 0)
        counts[n] = counts.get(n, 0) + k
    patterns = plan(counts, size)
    places = _places(patterns)

    order = Window.partitionBy("length", "__salt").orderBy("__deal")
    numbered = salted.withColumn("__number", F.row_number().over(order) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("__number").to_numpy() + first[base[length] + batch.column("__salt").to_numpy()]
            sequence, offset = np.empty_like(length), np.empty_like(length)
            for n in np.unique(length):
                at, table = length == n, places[n]
                begin, start, k, shift = table[np.searchsorted(table[:, 0], number[at], "right") - 1].T
                sequence[at] = start + (number[at] - begin) // k
                offset[at] = shift + (number[at] - begin) % k * n
            keep = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    placed = numbered.mapInArrow(place, extended(cut.select(*names).schema, "sequence_id bigint, offset bigint"))
    full = cut.filter(F.col("length") == size)
    taken = sum(times for times, _ in patterns)
    return placed.unionAll(full.select(*names, (F.lit(taken) + F.col("__deal")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
