"""Resolution commands as they arrive: the rules of ``operators.resolution`` on state that is kept.

Commands come as a stream, in order from batch to batch, and are keyed by their claim's
account.  What earlier commands have done lies in maps of the state store (claims, movements
made, exact tuples, successors used, idempotency keys), entry by entry, so an account's
history is never loaded; a batch's commands of an account are sorted and judged one by one.
Claims and the movements that stood before are tables.  After a failure the stream goes on
from its checkpoint, with the state of the last whole batch.

An idempotency key counts within an account; a command on a claim that isn't there is told
so whatever its key.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quillon.operators import resolution

_STORES = ("claims", "made", "at", "used", "keys")


class _Kept:
    """A dict of a state store's map: keys by their text, values pickled."""

    def __init__(self, state):
        self._state = state

    def get(self, key: Any, default: Any = None) -> Any:
        found = self._state.getValue((repr(key),))
        return default if found is None else pickle.loads(found[0])

    def __contains__(self, key: Any) -> bool:
        return self._state.containsKey((repr(key),))

    def __getitem__(self, key: Any) -> Any:
        return pickle.loads(self._state.getValue((repr(key),))[0])

    def __setitem__(self, key: Any, value: Any) -> None:
        self._state.updateValue((repr(key),), (pickle.dumps(value),))

    def add(self, key: Any) -> None:
        self[key] = True


class _Tuples(_Kept):
    """Sets by key, written back when something is added."""

    def setdefault(self, key: Any, _: Any):
        return _Added(self, key)


class _Added:
    def __init__(self, store: _Tuples, key: Any):
        self._store, self._key = store, key

    def add(self, item: Any) -> None:
        self._store[self._key] = self._store.get(self._key, set()) | {item}


class Resolver(StatefulProcessor):
    """Judges an account's commands in order; ``order`` and ``kept`` name columns."""

    def __init__(self, order: list[str], kept: list[str]):
        self._order, self._kept = order, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._book = resolution.Book()
        for name in _STORES:
            state = handle.getMapState(name, "key string", "value binary")
            setattr(self._book, name, (_Tuples if name == "at" else _Kept)(state))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        arrived = [pickle.loads(c) for part in rows for c in part["command"]]
        arrived.sort(key=lambda c: tuple(c[o] for o in self._order))
        done = [(*(c[k] for k in self._kept), *self._book.apply(c)) for c in arrived]
        names = [*self._kept, *(f.split()[0] for f in resolution.RESULT.split(", "))]
        out = pd.DataFrame(done, columns=names)
        yield out.astype({"sequence": "Int32"})

    def close(self) -> None:
        pass


def _pickled(rows: DataFrame, kept: list[str]) -> DataFrame:
    """``account`` and the whole command as bytes, so that its values reach the rules as they are."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            commands = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([c["__account"] for c in commands], pa.string()), pa.array([pickle.dumps(c) for c in commands], pa.binary())], names=["account", "command"])

    return rows.withColumn("__account", F.coalesce(F.col("o_account").cast("string"), F.lit("(none)"))).mapInArrow(run, "account string, command binary")


def resolve(commands: DataFrame, claims: DataFrame, movements: DataFrame, order: list[str], kept: list[str]) -> DataFrame:
    """A stream of commands (as in ``operators.resolution.resolve``) to one of their results:
    the columns ``kept`` and those of ``RESULT``."""
    schema = StructType([*(commands.schema[k] for k in kept), *StructType.fromDDL(resolution.RESULT).fields])
    facts = resolution.with_facts(commands, claims, movements)
    return _pickled(facts, kept).groupBy("account").transformWithStateInPandas(Resolver(order, kept), schema, "append", "none")
