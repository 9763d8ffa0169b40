"""Printed pages as tokens: lines of text, bands of columns."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import recognised

#: Left and right edge of each column of the historical statement.
BANDS = {"date": (40, 94), "branch": (94, 150), "description": (150, 286), "reference": (286, 360), "debit": (360, 426), "credit": (426, 505), "balance": (505, 606)}


def _placed(middles: list[float], tolerance: float) -> list[int]:
    """Numbers of a page's lines, for tokens in reading order."""
    # lines from the top; a mean goes at most half of the way to its neighbour's, so they stay in order
    means, numbers, sizes, found = [], [], [], []
    at = None
    for y in middles:
        if at is None or means[at] != y:
            at = bisect_left(means, y)
            if at and (at == len(means) or (y - means[at - 1], numbers[at - 1]) < (means[at] - y, numbers[at])):
                at -= 1
            if at == len(means) or abs(means[at] - y) > tolerance:
                at = bisect_left(means, y)
                means.insert(at, y)
                numbers.insert(at, len(sizes))
                sizes.append(0)
        number = numbers[at]
        sizes[number] += 1
        means[at] += (y - means[at]) / sizes[number]
        found.append(number)
    rank = {k: n + 1 for n, k in enumerate(numbers)}
    return [rank[k] for k in found]


def lines(tokens: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Adds ``line``: in reading order, a token joins the line whose mean height is nearest,
    if within ``tolerance``, and moves its mean; else it opens one.  Pages arrive sorted and in
    a stream; a task holds one page and a batch."""
    schema = tokens.select("*", F.lit(0).alias("line")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in chain(batches, [None]):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                table = table if rest is None else pa.concat_tables([rest, table])
            elif rest is None:
                return
            else:
                table = rest
            keys = list(zip(table.column("doc_id").to_pylist(), table.column("page").to_pylist(), strict=True))
            cuts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
            if batch is None:
                cuts.append(len(keys))
            rest = table.slice(cuts[-1]) if cuts else None
            if len(cuts) < 2:
                continue
            whole = table.slice(0, cuts[-1])
            middles = [float(a + b) / 2 for a, b in zip(whole.column("y0").to_pylist(), whole.column("y1").to_pylist(), strict=True)]
            found = [n for a, b in zip(cuts, cuts[1:], strict=False) for n in _placed(middles[a:b], tolerance)]
            yield from whole.append_column("line", pa.array(found, pa.int32())).combine_chunks().to_batches()

    return tokens.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "y0", "x0", "x1", "ordinal").mapInArrow(run, schema)


LINE = "page int, line int, y0 double, y1 double, key string, t array<struct<x0: double, ordinal: int, x1: double, text: string, label: string>>"


def lines_of(tokens: Column, tolerance: float = 2.0) -> Column:
    """Lines of a document's tokens (page, ordinal, text, x0, x1, y0, y1), numbered as by ``lines``, from
    the first page's top on: edges, words for comparison, tokens from left to right.

    Tokens that lie in one row need no exchange; a task holds a batch of documents."""

    @F.arrow_udf(f"array<struct<{LINE}>>")
    def run(tokens: pa.Array) -> pa.Array:
        flat, ends = tokens.flatten(), np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
        doc = np.repeat(np.arange(len(tokens)), np.diff(ends, prepend=0))
        page, ordinal, x0, x1, y0, y1 = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("page", "ordinal", "x0", "x1", "y0", "y1"))
        order = np.lexsort((ordinal, x1, x0, y0, page, doc))
        middles = (y0 + y1)[order] / 2
        pages = np.flatnonzero(np.diff(page[order], prepend=-1) | np.diff(doc[order], prepend=-1)).tolist()
        heights, line = middles.tolist(), np.zeros(len(order), np.int32)
        for a, b in pairwise([*pages, len(order)]):
            line[order[a:b]] = _placed(heights[a:b], tolerance)
        order = np.lexsort((x1, ordinal, x0, line, page, doc))
        doc, page, line = doc[order], page[order], line[order]
        starts = np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(page, prepend=-1) | np.diff(line, prepend=-1))
        cuts = np.append(starts, len(order))
        words = flat.field("text").dictionary_encode()
        label = pa.array([None if w is None else recognised(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
        flat, label = flat.take(pa.array(order)), label.take(pa.array(order))
        said = label.to_pylist()
        key = [" ".join(filter(None, said[a:b])) for a, b in pairwise(cuts)]
        of_line = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([flat.field("x0"), flat.field("ordinal"), flat.field("x1"), flat.field("text"), label], ["x0", "ordinal", "x1", "text", "label"]))
        least, most = (f.reduceat(y[order], starts) if len(starts) else np.zeros(0) for f, y in ((np.minimum, y0), (np.maximum, y1)))
        found = pa.StructArray.from_arrays([pa.array(page[starts], pa.int32()), pa.array(line[starts]), pa.array(least), pa.array(most), pa.array(key, pa.string()), of_line], ["page", "line", "y0", "y1", "key", "t"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[starts], np.arange(len(tokens) + 1)), pa.int32()), found)

    return run(tokens)
