"""Exact numbers of byte-pair tokens, without making the tokens.

A word starts as a doubly linked list of its bytes.  A heap holds the rank and the place
of every adjacent pair that has a merge; the lowest one is popped again and again, its
two symbols become one, and the pairs with the new neighbours join the heap.  The word
has as many tokens as it had bytes, less the merges, so the result is a sum of numbers and
no list of ids is ever built.

A word takes time n log n in its length, so texts without a single blank are no
exception.  Words repeat: a task keeps the counts of short words seen before in two
bounded generations, of which the older goes when the younger is full (this changes
speed, never a result).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillon.llm.bpe import SPLIT, printable
from quillon.llm.common import extended

CACHE_ENTRIES = 1_000_000
#: Longer words are counted anew each time.
CACHED_CHARS = 256


class Counter:
    """Counts tokens as the vocabulary of a ``tokenizers`` JSON file makes them."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, of_char = spec["model"]["vocab"], printable()
        #: two symbols, as one number, to the rank of their merge; the symbol that a rank makes
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks.setdefault(vocab[a] << 32 | vocab[b], rank)
            self.made.append(vocab[a + b])
        self.symbol = [-1] * 256
        for char, byte in of_char.items():
            self.symbol[byte] = vocab[char]
        special = [re.escape(t["content"]) for t in spec.get("added_tokens", ())]
        self.at_special = re.compile("|".join(sorted(special, key=len, reverse=True))) if special else None
        self.split = regex.compile(SPLIT)
        self.cache_entries = cache_entries
        self._words: dict[str, int] = {}
        self._older: dict[str, int] = {}

    def word(self, data: bytes) -> int:
        """Tokens of one word (a match of ``SPLIT``): its bytes less its merges."""
        symbols = [self.symbol[b] for b in data]
        n, find, made = len(symbols), self.ranks.get, self.made
        heap = [rank * n + at for at in range(n - 1) if (rank := find(symbols[at] << 32 | symbols[at + 1])) is not None]
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left_over = n
        while heap:
            rank, left = divmod(heappop(heap), n)
            # what an earlier merge has changed is another pair by now, or gone
            if (right := after[left]) >= n or (mine := symbols[left]) < 0 or find(mine << 32 | symbols[right]) != rank:
                continue
            left_over -= 1
            whole = symbols[left] = made[rank]
            symbols[right] = -1
            after[left] = following = after[right]
            if following < n:
                before[following] = left
                if (found := find(whole << 32 | symbols[following])) is not None:
                    heappush(heap, found * n + left)
            if (previous := before[left]) >= 0 and (found := find(symbols[previous] << 32 | whole)) is not None:
                heappush(heap, found * n + previous)
        return left_over

    def _new(self, word: str) -> int:
        """Tokens of a word that isn't in the younger generation."""
        found = self._older.get(word)
        if found is None:
            found = self.word(word.encode())
        if len(word) <= CACHED_CHARS:
            if len(self._words) >= self.cache_entries // 2:
                self._older, self._words = self._words, {}
            self._words[word] = found
        return found

    def _plain(self, text: str) -> int:
        get, new = self._words.get, self._new
        words = self.split.findall(text)
        known = list(map(get, words))
        if None in known:
            return sum(k or new(w) for k, w in zip(known, words, strict=True))
        return sum(known)

    def count(self, text: str) -> int:
        """Tokens of a text; a special token's string in it is one token."""
        if self.at_special is None:
            return self._plain(text)
        parts = self.at_special.split(text)
        return len(parts) - 1 + sum(self._plain(p) for p in parts if p)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter per vocabulary in a Python worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_bytes (of the text in UTF-8), n_tokens and over_limit (n_tokens above ``limit``).

    ``keep`` names the other columns of the result (all by default; columns with one of
    the three names give way).  A null text counts as empty: no bytes, no tokens.  Texts
    of any length are counted whole; repeated rows stay; an empty table gives an empty
    result.  ``path`` must name a vocabulary file that every executor has at the same place.
    """
    added = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    source = docs.select(*(docs[c].alias(f"__in{k}") for k, c in enumerate(kept)), docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            size, n = [], []
            for value in batch.column("__text"):
                t = value.as_py() or ""
                size.append(len(t.encode()))
                n.append(own.count(t))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(kept))), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[*(f"__in{k}" for k in range(len(kept))), *added],
            )

    found = source.mapInArrow(run, extended(source.drop("__text").schema, "n_bytes bigint, n_tokens bigint, over_limit boolean"))
    return found.toDF(*kept, *added)
