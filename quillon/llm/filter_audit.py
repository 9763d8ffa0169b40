"""What filters remove alone, together and in every order, kept up to date file by file.

The table's files are read as micro-batches of a stream that ends when all that is there
has been read.  Four filters look at a document alone; the fifth fails a document whose
text a smaller doc_id has too, in whatever file.  So a state, keyed by text, holds the least
doc_id seen so far and how many rows of each part hold it.  When a smaller one arrives,
the earlier mask of these rows (fifth filter passed) is retracted from the part's
counters and the mask with the failure is counted in its place.

A micro-batch writes the changes it makes to the counters (part, mask, labels) under its
number, so that one that is run again replaces its own; the sum of all changes is the
truth about the files read so far.  The folder keeps offsets, state and changes: a later
run on it takes up the files that are new.

Equal texts are summed up where they are read, and once more in salted shares, before they
meet in their state, so that a text of a third of all rows is a handful of rows there.  A
text's state lies in a bucket with others (vectors instead of calls for each text);
buckets are as many as the table's bytes ask for.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.llm.common import materialise, remove, shared_dir

FILTERS = "ABCDE"
#: Letters and signs that the filters look for.
UPPER, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Bytes of the table to a bucket of state.
BUCKET_BYTES = 512 << 10
#: Shares of a text in one micro-batch before they meet.
SALT = 16
_CELL = ["part", "quality", "toxic"]
_GROUP = ["key", "mask", "known", *_CELL]


def mask_of(raw: bytes) -> int:
    """Bit 0 to 3: the text fails filter A to D."""
    words = raw.split()  # at the bytes 9 to 13 and 32
    points = len(raw) if raw.isascii() else len(raw.decode())
    upper = len(raw) - len(raw.translate(None, UPPER))
    signs = len(raw.translate(None, SIGNS)) < len(raw)
    return (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * upper > 10 * points) << 2 | signs << 3


def _slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, masks = [], []
        for value in batch.column("text"):
            raw = (value.as_py() or "").encode()
            keys.append(hashlib.blake2b(raw, digest_size=16).digest())
            masks.append(mask_of(raw))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(keys, pa.binary()), pa.array(masks, pa.int32())], names=["doc_id", "part", "key", "mask"])


def _summed(rows: pa.Table) -> pa.Table:
    """One row for each text, mask and cell: n rows, of which n_least have the least doc_id."""
    same = rows.group_by([*_GROUP, "least"]).aggregate([("n", "sum"), ("n_least", "sum")])
    out = same.sort_by("least").group_by(_GROUP, use_threads=False).aggregate([("n_sum", "sum"), ("least", "first"), ("n_least_sum", "first")])
    return out.rename_columns({"n_sum_sum": "n", "least_first": "least", "n_least_sum_first": "n_least"}).select([*_GROUP, "n", "least", "n_least"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= 200_000:
            yield from _summed(pa.Table.from_batches(held)).to_batches()
            held, n = [], 0
    if n:
        yield from _summed(pa.Table.from_batches(held)).to_batches()


_STATE = ["key", "mask", *_CELL, "least", "n_least"]


def _retract(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Brings a bucket's texts up to date; yields the changes to the counters."""
    new = pd.concat(list(frames), ignore_index=True)
    nameless = new[~new["known"]]  # without a doc_id: the fifth filter passes them, and they fail nobody
    new = new[new["known"]]
    earlier = state.getOption
    old = pa.ipc.open_stream(earlier[0]).read_all().to_pandas() if earlier else pd.DataFrame({c: new[c].iloc[:0] for c in _STATE})
    both = pd.concat([old.assign(n=0, old=True), new.assign(old=False)], ignore_index=True)
    codes, _ = pd.factorize(both["key"])
    best = np.full(codes.max(initial=-1) + 1, np.iinfo(np.int64).max)
    ids, was, n, n_least = both["least"].to_numpy(np.int64), both["old"].to_numpy(bool), both["n"].to_numpy(np.int64), both["n_least"].to_numpy(np.int64)
    np.minimum.at(best, codes, ids)
    first = ids == best[codes]
    # old rows are counted as passing; new ones aren't counted yet
    passing = np.where(was, np.where(first, 0, -n_least), np.where(first, n_least, 0))
    failing = np.where(was, np.where(first, 0, n_least), n - np.where(first, n_least, 0))
    cells, masks = both[_CELL], both["mask"].to_numpy(np.int32)
    changes = pd.concat(
        [
            cells.assign(mask=masks, n=passing),
            cells.assign(mask=masks | 16, n=failing),
            nameless[[*_CELL, "mask", "n"]],
        ],
        ignore_index=True,
    )
    changes = changes[changes["n"] != 0].groupby([*_CELL, "mask"], as_index=False, dropna=False)["n"].sum()
    kept = both.loc[first, _STATE].groupby([c for c in _STATE if c != "n_least"], as_index=False, sort=False)["n_least"].sum()
    table = pa.Table.from_pandas(kept[_STATE], preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    state.update((sink.getvalue().to_pybytes(),))
    yield changes[[*_CELL, "mask", "n"]]


def _source(spark: SparkSession, path: str) -> tuple[str, int]:
    """The path as a stream takes it, and its bytes.  A single file is named by a pattern, as a stream's own path must be a folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{path[:-1]}[{path[-1]}]" if system.getFileStatus(target).isFile() else path, system.getContentSummary(target).getLength()


def update(spark: SparkSession, path: str, labels: DataFrame, folder: str, batches: int = 4, buckets: int | None = None) -> DataFrame:
    """Reads the Parquet files below ``path`` that ``folder`` doesn't know yet; returns all counters.

    The files are dealt into about ``batches`` micro-batches.  ``buckets`` must be the same
    for all runs on one folder.  Returns part, quality, toxic, mask and n; bit k of the mask
    says that filter k fails.
    """
    there = spark.read.parquet(path)
    files = max(1, -(-len(there.inputFiles()) // batches))
    source, size = _source(spark, path)
    count = buckets or max(64, size // BUCKET_BYTES)
    # the oldest files count too, however much younger others are
    stream = spark.readStream.schema(there.schema).option("maxFilesPerTrigger", files).option("maxFileAge", "100000d").parquet(source)
    slim = stream.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text").mapInArrow(
        _slim, "doc_id bigint, part string, key binary, mask int"
    )
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.expr("max(quality <=> 1)").alias("quality"), F.expr("max(toxic <=> 1)").alias("toxic"))
    # rows without a doc_id are spread over the tasks
    marked = slim.withColumn("link", F.coalesce("doc_id", -1 - F.shiftrightunsigned(F.xxhash64("key", F.rand()), 1))).join(marks, (F.col("link") == F.col("label_id")) & F.col("doc_id").isNotNull(), "left")
    marked = marked.select("key", "mask", F.col("doc_id").isNotNull().alias("known"), "part", F.coalesce("quality", F.lit(False)).alias("quality"), F.coalesce("toxic", F.lit(False)).alias("toxic"), F.lit(1).cast("long").alias("n"), F.coalesce("doc_id", F.lit(0)).alias("least"), F.lit(1).cast("long").alias("n_least"))
    kind = "key binary, mask int, known boolean, part string, quality boolean, toxic boolean, n bigint, least bigint, n_least bigint"
    shares = marked.mapInArrow(_combine, kind).repartition("key", F.pmod(F.xxhash64("key", "least"), F.lit(SALT)))
    bucketed = shares.mapInArrow(_combine, kind).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(count)))
    changes = bucketed.groupBy("bucket").applyInPandasWithState(_retract, "part string, quality boolean, toxic boolean, mask int, n bigint", "rows binary", "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*_CELL, "mask").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every small store takes megabytes beforehand
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        query = changes.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(write).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return counters(spark, folder)


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of the changes in ``folder``: part, quality, toxic, mask, n (without zeros)."""
    kind = "part string, quality boolean, toxic boolean, mask int, n bigint, batch bigint"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/changes")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], kind).drop("batch")
    changes = spark.read.schema(kind).parquet(f"{folder}/changes")
    return changes.groupBy(*_CELL, "mask").agg(F.sum("n").alias("n")).filter("n <> 0")


def interactions(counts: DataFrame) -> DataFrame:
    """Counters as rows of part, filter_order (every order of the filters), step and what the step's filter does.

    kept: rows that pass it and all before; removed: that fail it and none before; redundant:
    that fail it and one before; unique_fails: that fail it alone; good_lost and toxic_lost:
    removed ones with quality and toxic; shapley: its removed, added up over all orders.
    """
    spark, steps = counts.sparkSession, []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            steps.append(f"('{''.join(order)}', {step}, {bit}, {before})")
            before |= bit
    orders = spark.sql(f"SELECT * FROM VALUES {', '.join(steps)} AS s(filter_order, step, bit, before)")
    fails, passed = "mask & bit <> 0", "mask & before = 0"
    # every mask with every step: a table of fixed size
    table = orders.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))).alias("mask")).selectExpr(
        "mask", "filter_order", "step",
        f"int({passed} AND NOT {fails}) AS is_kept", f"int({passed} AND {fails}) AS is_removed", f"int(NOT {passed} AND {fails}) AS is_redundant", "int(mask = bit) AS is_unique",
        f"IF({fails}, 120 div greatest(bit_count(mask), 1), 0) AS orders_removed",
    )
    sums = {
        "kept": "n * is_kept", "removed": "n * is_removed", "redundant": "n * is_redundant", "unique_fails": "n * is_unique",
        "good_lost": "n * is_removed * int(quality)", "toxic_lost": "n * is_removed * int(toxic)", "shapley": "n * orders_removed",
    }
    return counts.join(F.broadcast(table), "mask").groupBy("part", "filter_order", "step").agg(*(F.expr(f"CAST(sum({e}) AS BIGINT)").alias(c) for c, e in sums.items()))


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = 4) -> DataFrame:
    """``interactions`` of a whole table, from a folder of its own that is gone afterwards.

    The filters fail a text with A: under 100 words; B: 100 distinct words < 80 words;
    C: 100 letters A to Z > 10 code points; D: any of ``#$%&*|``; E: a smaller doc_id with the
    same text.  A null text is an empty one; a null language makes the part of the empty
    string; of repeated rows (doc_id and text) none fails for another; a row without a
    doc_id passes E and fails nobody; several labels of one doc_id count if any is 1; an
    empty table gives an empty result.
    """
    folder = f"{shared_dir(spark)}/filters-{uuid.uuid4().hex}"
    try:
        return interactions(materialise(update(spark, path, labels, folder, batches), "counters"))
    finally:
        remove(spark, folder)
