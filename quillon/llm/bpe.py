"""Exact byte-level BPE by dynamic programming over prefixes.

For every prefix of a word there is exactly one token that can be the last of the
prefix's encoding.  An automaton over the vocabulary finds the tokens that end at each
position (all suffix matches); the one that is compatible with the last token of what
stands before it is stored, and following these back-pointers from the end of the word
emits the ids.  Two tokens are compatible if no merge that crosses their border would
have come before both were complete, which a look at the outer spines of their merge
trees decides.

Words repeat, so each task keeps the ids of words seen before, in two bounded
generations of which the older goes when the younger is full (this changes speed, never a
result).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillon.llm.common import extended

#: The split pattern of byte-level BPE vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space next to white space, where a blank is not the start of a word.
_RUN = re.compile(r"[\s\x1c-\x1f\x85][\s\x1c-\x1f\x85]")
CACHE_ENTRIES = 400_000


def printable() -> dict[str, int]:
    """Character of a vocabulary file to the byte it stands for."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(other)}


class Encoder:
    """Encodes and decodes with the vocabulary of a ``tokenizers`` JSON file."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of_char = printable()
        raw = lambda token: bytes(of_char[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = raw(token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.pairs: dict[tuple[int, int], int] = {}  # parts to the rank of their merge
        made: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b, whole = vocab[a], vocab[b], vocab[a + b]
            self.pairs.setdefault((a, b), rank)
            made.setdefault(whole, (rank, a, b))
        self._made = made
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for i in vocab.values():
            self.automaton.add_word(self.bytes_of[i].decode("latin-1"), (i, len(self.bytes_of[i])))
        self.automaton.make_automaton()
        self.split = regex.compile(SPLIT)
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.cache_entries = cache_entries
        self._words: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    def _spine(self, token: int, side: int, kept: dict) -> list[tuple[int, float]]:
        """Outer parts of a token with the rank at which each goes up in its parent."""
        if token not in kept:
            out, part, until = [], token, float("inf")
            while True:
                out.append((part, until))
                if part not in self._made:
                    break
                until, part = self._made[part][0], self._made[part][side]
            kept[token] = out
        return kept[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of ``a``'s bytes followed by ``b``'s is just these two."""
        fits = True
        for x, x_until in self._spine(a, 2, self._right):
            for y, y_until in self._spine(b, 1, self._left):
                rank = self.pairs.get((x, y))
                # of equal merges the left one goes first
                if rank is not None and rank < x_until and rank <= y_until:
                    fits = False
        if len(self._fits) >= 1_000_000:
            self._fits.clear()
        self._fits[a, b] = fits
        return fits

    def word(self, data: bytes) -> list[int]:
        """Ids of one word (a match of ``SPLIT``), by the table of last tokens."""
        last = [-1] * (len(data) + 1)
        known, compatible = self._fits.get, self.compatible
        for at, (token, n) in self.automaton.iter(data.decode("latin-1")):
            end = at + 1
            if last[end] >= 0:
                continue
            if end == n:
                last[end] = token
            elif (before := last[end - n]) >= 0:
                fits = known((before, token))
                if compatible(before, token) if fits is None else fits:
                    last[end] = token
        out, end = [], len(data)
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def _keep(self, chunk: str, ids: tuple[int, ...]) -> None:
        if len(self._words) >= self.cache_entries // 2:
            self._older, self._words = self._words, {}
        if len(chunk) <= 256:
            self._words[chunk] = ids

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a chunk that isn't in the younger generation."""
        out = self._older.get(chunk)
        if out is None:
            words = self.split.findall(chunk)
            if len(words) == 1:
                out = tuple(self.word(chunk.encode()))
            else:
                out = tuple(i for w in words for i in self._words.get(w) or self._chunk(w))
        self._keep(chunk, out)
        return out

    def _plain(self, text: str, out: list[int]) -> None:
        """Between two characters that are not white space, a blank starts a word."""
        if _RUN.search(text):
            parts = self.split.findall(text)
        else:
            parts = text.split(" ")
            parts[1:] = [" " + p for p in parts[1:]]
        get = self._words.get
        for p in parts:
            out.extend(get(p) or self._chunk(p))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if not self.at_special:
            self._plain(text, out)
            return out
        for k, part in enumerate(self.at_special.split(text)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                self._plain(part, out)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per vocabulary in a Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_native: dict[str, Callable[[str], np.ndarray]] = {}


def ids_of(path: str) -> Callable[[str], np.ndarray]:
    """The same ids by the tiktoken library, for operators that only need ids.

    It takes ranks for ids, so where a vocabulary numbers its tokens otherwise, and for
    texts that its pattern matcher refuses (very long runs of white space), ``Encoder``
    does the work.
    """
    if path not in _native:
        own = encoder(path)
        made = [(own.pairs[a, b], i) for i, (_, a, b) in own._made.items()]
        plain = {own.bytes_of[i]: i for i in range(len(own.bytes_of)) if own.bytes_of[i] and i not in own.special.values()}
        if [i for _, i in sorted(made)] == sorted(i for _, i in made) and all(bytes([b]) in plain for b in range(256)):
            import tiktoken

            native = tiktoken.Encoding("native", pat_str=SPLIT, mergeable_ranks=plain, special_tokens=own.special)

            def ids(text: str) -> np.ndarray:
                try:
                    return native.encode_to_numpy(text, allowed_special="all")
                except ValueError:
                    return np.asarray(own.encode(text), np.uint32)

        else:

            def ids(text: str) -> np.ndarray:
                return np.asarray(own.encode(text), np.uint32)

        _native[path] = ids
    return _native[path]


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids`` (array of int) and ``decoded`` (what these ids decode to).

    ``keep`` names the other columns of the result (all by default; columns named ``ids``
    or ``decoded`` give way).  A null text counts as empty and has no ids; repeated rows
    stay; an empty table gives an empty result.  ``path`` must name a vocabulary file that
    every executor has at the same place.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "decoded")]
    source = docs.select(*kept, docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                rows = batch.slice(start, 64)
                ids = [bpe.encode(t or "") for t in rows.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(rows.column(c) for c in kept),
                        pa.array([np.asarray(x, np.int32) for x in ids], pa.list_(pa.int32())),
                        pa.array(map(bpe.decode, ids), pa.string()),
                    ],
                    names=[*kept, "ids", "decoded"],
                )

    return source.mapInArrow(run, extended(source.drop("__text").schema, "ids array<int>, decoded string"))


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``key``, n_tokens, ids_sha256 and decoded_sha256.

    Ids count as little-endian unsigned 32-bit integers; nulls as in ``encode``.
    """
    source = docs.select(docs[key].alias("__key"), docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for value in batch.column("__text"):
                ids = bpe.encode(value.as_py() or "")
                n.append(len(ids))
                of_ids.append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("__key"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = source.schema["__key"].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
