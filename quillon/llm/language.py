"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a document's bytes from both sides, white space included, gives every
position a probability for each language, and a document's probabilities are the mean over
its positions.  To read many positions at once, documents are cut into windows of ``WINDOW``
bytes, and each direction starts ``WARM_UP`` bytes before its window.  The state that a
window begins in is then held against the one that its neighbour ended in: where they
differ by more than ``TOLERANCE``, the window is read again from the neighbour's, and so
on until all agree.  So a document of any length is read as if in one go.

The network is trained in numpy by backpropagation through time on pieces of a bounded
sample of labelled documents, drawn evenly from the languages and from all over the texts;
all documents are labelled whole.

* a null text, or one without a letter, has language ``und`` and score 0
* rows without a language, or with a null key, aren't learned from
* without a row to learn from every document is ``und``
* repeated rows stay; an empty table gives an empty result; only the named columns take part
* scores are rounded to six digits, as sums in single precision depend on the batch
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import extended

WINDOW, WARM_UP, TOLERANCE = 2048, 128, 1e-2
#: Bytes of windows that are read together.
BLOCK = 1 << 21
#: Bytes of texts whose windows are read together, in blocks; a longer text is read alone.
POOL = 1 << 24
#: Bytes of windows whose inputs are looked up at once.
AHEAD = 1 << 12
#: Documents that are sampled to learn from, and characters of each that are.
FIT_DOCS, FIT_CHARS = 1200, 16_384
#: Steps of the training, pieces of a step and their length.
STEPS, PIECES, LENGTHS = 400, 96, (12, 96)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGru:
    """Weights are in ``p``; sequences of one length make up a batch (rows, positions)."""

    def __init__(self, classes: int, hidden: int = 8, embed: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b)).astype(np.float32)
        self.hidden = hidden
        self.p = {"out": draw(2 * hidden, classes), "out_b": np.zeros(classes, np.float32), "embed": draw(256, embed) * 8}
        for d in "fb":
            self.p |= {f"x{d}": draw(embed, 3 * hidden), f"h{d}": draw(hidden, 3 * hidden), f"b{d}": np.zeros(3 * hidden, np.float32)}

    def _run(self, x: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """States (positions, rows, hidden) of one direction, in reading order."""
        H, table = self.hidden, self.p["embed"] @ self.p[f"x{d}"] + self.p[f"b{d}"]
        h, wh = np.zeros((len(x), H), np.float32), self.p[f"h{d}"]
        out = np.empty((x.shape[1], len(x), H), np.float32)
        for t in range(x.shape[1]):
            gx, gh = table[x[:, t]], h @ wh
            gates = sigmoid(gx[:, : 2 * H] + gh[:, : 2 * H])
            r, z = gates[:, :H], gates[:, H:]
            n = np.tanh(gx[:, 2 * H :] + r * gh[:, 2 * H :])
            if trace is not None:
                trace.append((h, r, z, n, gh[:, 2 * H :]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def probabilities(self, x: np.ndarray, lengths: np.ndarray | None = None, start: np.ndarray | None = None, own: np.ndarray | None = None, states: np.ndarray | None = None) -> np.ndarray:
        """(positions, rows, classes); rows have falling ``lengths``, what follows is not read.

        ``start`` (2, rows, hidden) is where the two directions begin, zeros by default.  With
        ``own`` (rows, first and last + 1 position), ``states`` (2, 2, rows, hidden) gets each
        direction's state as it enters and as it leaves these positions.

        Rows come last in all that is computed, so that each operation runs along many of them.
        """
        H, T, N = self.hidden, x.shape[1], len(x)
        out, read = np.zeros((T, len(self.p["out_b"]), N), np.float32), np.ascontiguousarray(x.T)
        # how many rows reach each position: the first ones
        active = np.full(T, N) if lengths is None else np.searchsorted(-lengths, -np.arange(T), "left")
        ahead = max(1, AHEAD // max(1, N))
        # a gate that is wide open or shut may overflow on the way to 0 or 1
        with np.errstate(over="ignore"):
            for side, d in enumerate("fb"):
                self._read(side, d, read, active, ahead, out, start, own, states)
        out += self.p["out_b"][:, None]
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out.transpose(0, 2, 1)

    def _read(self, side: int, d: str, read: np.ndarray, active: np.ndarray, ahead: int, out: np.ndarray, start: np.ndarray | None, own: np.ndarray | None, states: np.ndarray | None) -> None:
        """Adds to ``out`` (positions, classes, rows) what one direction gives."""
        H, (T, N) = self.hidden, read.shape
        # after which position which rows' states are wanted
        wanted: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        if own is not None:
            for where, at in enumerate((own[:, 0] - 1, own[:, 1] - 1) if d == "f" else (own[:, 1], own[:, 0])):
                states[side, where] = 0 if start is None else start[side]
                for t in np.unique(at).tolist():
                    wanted.setdefault(t, []).append((states[side, where], np.flatnonzero(at == t)))
        # sigmoid(x) is 1 / (1 + exp(-x)), tanh(x) is 1 - 2 / (1 + exp(2 x))
        scale = np.array([-1] * 2 * H + [2] * H, np.float32)
        table, wh = (np.ascontiguousarray((m * scale).T) for m in (self.p["embed"] @ self.p[f"x{d}"] + self.p[f"b{d}"], self.p[f"h{d}"]))
        w, state = np.ascontiguousarray((self.p["out"][:H] if d == "f" else self.p["out"][H:]).T), np.zeros((H, N), np.float32)
        if start is not None:
            state[:] = start[side].T
        room = [np.empty((height, N), np.float32) for height in (3 * H, 2 * H, H, len(w))]
        taken = np.empty(3 * H * ahead * N, np.float32)
        firsts = range(0, T, ahead) if d == "f" else range((T - 1) // ahead * ahead, -1, -ahead)
        for first in firsts:
            last = min(first + ahead, T)
            most = active[first]
            # what some positions' bytes give to the gates
            seen = taken[: 3 * H * (last - first) * most].reshape(3 * H, last - first, most)
            np.take(table, read[first:last, :most].astype(np.intp), axis=1, out=seen, mode="clip")
            for t in range(first, last) if d == "f" else range(last - 1, first - 1, -1):
                n = active[t]
                gx = seen[:, t - first, :n]
                h, (gh, gates, new, part) = state[:, :n], (m[:, :n] for m in room)
                np.matmul(wh, h, out=gh)
                np.add(gx[: 2 * H], gh[: 2 * H], out=gates)
                np.exp(gates, out=gates)
                gates += 1
                np.divide(gh[2 * H :], gates[:H], out=new)
                new += gx[2 * H :]
                np.exp(new, out=new)
                new += 1
                np.divide(-2, new, out=new)
                new += 1
                h -= new
                h /= gates[H:]
                h += new
                np.matmul(w, h, out=part)
                out[t, :, :n] += part
                if t in wanted:
                    for kept, rows in wanted[t]:
                        rows = rows[rows < n]
                        kept[rows] = h[:, rows].T

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean weighted cross-entropy over all positions, and its gradients."""
        H, p = self.hidden, self.p
        traces: dict[str, list] = {"f": [], "b": []}
        forward, backward = self._run(x, "f", traces["f"]), self._run(x[:, ::-1], "b", traces["b"])[::-1]
        both = np.concatenate([forward, backward], axis=2)
        logits = both @ p["out"] + p["out_b"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        prob = e / e.sum(axis=2, keepdims=True)
        scale = (weight / (weight.sum() * x.shape[1])).astype(np.float32)
        rows = np.arange(len(y))
        loss = -float((np.log(prob[:, rows, y] + 1e-9) * scale).sum())
        dl = prob.copy()
        dl[:, rows, y] -= 1
        dl *= scale[None, :, None]
        g = {"out": np.einsum("tnh,tnc->hc", both, dl, optimize=True), "out_b": dl.sum(axis=(0, 1)), "embed": np.zeros_like(p["embed"])}
        dboth = dl @ p["out"].T
        for d, dh_all, seen in (("f", dboth[:, :, :H], x), ("b", dboth[::-1, :, H:], x[:, ::-1])):
            gw, gb, dtable = np.zeros_like(p[f"h{d}"]), np.zeros_like(p[f"b{d}"]), np.zeros((256, 3 * H), np.float32)
            dh = np.zeros((len(x), H), np.float32)
            for t in range(x.shape[1] - 1, -1, -1):
                h, r, z, n, ghn = traces[d][t]
                dh = dh + dh_all[t]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * ghn * r * (1 - r)
                dgx = np.concatenate([dr, dz, dn], axis=1)
                dgh = np.concatenate([dr, dz, dn * r], axis=1)
                gw += h.T @ dgh
                gb += dgx.sum(axis=0)
                np.add.at(dtable, seen[:, t], dgx)
                dh = dh * z + dgh @ p[f"h{d}"].T
            g |= {f"h{d}": gw, f"b{d}": gb, f"x{d}": p["embed"].T @ dtable}
            g["embed"] += dtable @ p[f"x{d}"].T
        return loss, g


def train(docs: list[tuple[bytes, str]], seed: int = 7, steps: int = STEPS) -> tuple[list[str], BiGru]:
    """A network from (text, language), by Adam."""
    languages = sorted({lang for _, lang in docs})
    net = BiGru(len(languages), seed=seed)
    # one text of each language, all positions alike
    joined = [np.frombuffer(b"\n".join(t for t, lang in docs if lang == own), np.uint8) for own in languages]
    rng, m, v = np.random.default_rng(seed), {}, {}
    for step in range(1, steps + 1):
        n = int(rng.integers(*LENGTHS))
        y = rng.integers(0, len(languages), PIECES)
        at = [int(rng.integers(0, max(1, len(joined[k]) - n + 1))) for k in y]
        x = np.stack([np.resize(joined[k][a : a + n], n) for k, a in zip(y, at, strict=True)])
        _, g = net.gradients(x, y, np.ones(PIECES))
        rate = 0.01 * (1 - (step - 1) / steps)
        for name, grad in g.items():
            m[name] = 0.9 * m.get(name, 0) + 0.1 * grad
            v[name] = 0.99 * v.get(name, 0) + 0.01 * grad * grad
            net.p[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
    return languages, net


class Windows:
    """Windows of texts, with what reading each has given."""

    def __init__(self, net: BiGru, texts: list[bytes]):
        self.net, self.texts = net, texts
        self.text = np.array([k for k, t in enumerate(texts) for _ in range(0, len(t), WINDOW)], np.int64)
        self.at = np.array([at for t in texts for at in range(0, len(t), WINDOW)], np.int64)
        C = len(net.p["out_b"])
        self.sums, self.labels = np.zeros((len(self.at), C)), np.zeros((len(self.at), C), np.int64)
        self.states = np.zeros((2, 2, len(self.at), net.hidden), np.float32)
        size = np.array([len(t) for t in texts], np.int64)
        self.end = np.minimum(self.at + WINDOW, size[self.text]) if len(self.at) else self.at

    def read(self, which: np.ndarray, warm_up: int, start: np.ndarray | None = None) -> None:
        """Reads windows, each with ``warm_up`` bytes on both sides, beginning at ``start``."""
        size = np.array([len(self.texts[k]) for k in self.text[which]], np.int64)
        begin, end = np.maximum(self.at[which] - warm_up, 0), np.minimum(self.end[which] + warm_up, size)
        order = np.argsort(begin - end, kind="stable")
        while len(order):
            n = max(1, BLOCK // int(end[order[0]] - begin[order[0]]))
            now, order = order[:n], order[n:]
            rows, lengths = which[now], end[now] - begin[now]
            data = np.zeros((len(now), lengths[0]), np.uint8)
            data[np.arange(lengths[0]) < lengths[:, None]] = np.frombuffer(b"".join(self.texts[self.text[r]][a:b] for r, a, b in zip(rows, begin[now], end[now], strict=True)), np.uint8)
            own = np.stack([self.at[rows] - begin[now], self.end[rows] - begin[now]], axis=1)
            states = np.empty((2, 2, len(now), self.net.hidden), np.float32)
            prob = self.net.probabilities(data, lengths, None if start is None else start[:, now], own, states)
            self.states[:, :, rows] = states
            # a class's rows of all positions lie together
            by_class, at = prob.transpose(2, 0, 1), np.arange(prob.shape[0])[:, None]
            outside = (at < own[:, 0]) | (at >= own[:, 1])
            best, top = np.zeros(outside.shape, np.int8), by_class[0].copy()
            for c in range(1, len(by_class)):
                best[by_class[c] > top] = c
                np.maximum(top, by_class[c], out=top)
            best[outside] = -1
            for c, p in enumerate(by_class):
                self.sums[rows, c] = np.where(outside, np.float32(0), p).sum(axis=0, dtype=np.float64)
                self.labels[rows, c] = (best == c).sum(axis=0)

    def settle(self) -> int:
        """Reads again what didn't begin where its neighbours ended; how many windows that took."""
        again = 0
        near = np.flatnonzero(self.text[1:] == self.text[:-1])  # these and the next ones are neighbours
        while len(near):
            apart = np.abs(self.states[0, 0, near + 1] - self.states[0, 1, near]).max(axis=1) > TOLERANCE
            behind = np.abs(self.states[1, 0, near] - self.states[1, 1, near + 1]).max(axis=1) > TOLERANCE
            which = np.union1d(near[apart] + 1, near[behind])
            if not len(which):
                break
            again += len(which)
            start = np.zeros((2, len(self.at), self.net.hidden), np.float32)
            start[0, near + 1], start[1, near] = self.states[0, 1, near], self.states[1, 1, near + 1]
            self.read(which, 0, start[:, which])
        return again


def pooled(net: BiGru, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sums of its positions' probabilities and the counts of their labels."""
    found = Windows(net, texts)
    found.read(np.arange(len(found.at)), WARM_UP)
    found.settle()
    sums, labels = np.zeros((len(texts), found.sums.shape[1])), np.zeros((len(texts), found.sums.shape[1]), np.int64)
    np.add.at(sums, found.text, found.sums)
    np.add.at(labels, found.text, found.labels)
    return sums, labels


def fit(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", n_docs: int = FIT_DOCS) -> tuple[list[str], BiGru] | None:
    """Learns from at most ``n_docs`` rows with a word, drawn by a hash of ``key`` and text of
    those for which ``learn`` holds, and of each from at most ``FIT_CHARS`` characters in a
    row, from a place that the hash tells: that much comes to the driver, whatever repeats.
    A share of the rows that holds about twice as many is put in order, so that tasks
    have little to send."""
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\S") & F.col(key).isNotNull())
    drawn = F.xxhash64(F.col(key), F.col(text))
    place = F.pmod(drawn, F.greatest(F.length(text) - FIT_CHARS, F.lit(0)) + 1) + 1
    sample = rows.select(drawn.alias("h"), F.substring(F.col(text), place.cast("int"), F.lit(FIT_CHARS)).alias("t"), F.col(lang).alias("l"))
    share = min(1.0, 2 * n_docs / max(1, rows.count()))
    drawn = sample.filter(F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(F.pmod("h", F.lit(1 << 30)), "h", "l").limit(n_docs)
    found = sorted({(r["t"].encode(), r["l"]) for r in drawn.collect()})
    return train(found) if found else None


def _pools(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows, as many in turn as begin within ``POOL`` bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column("__text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.flatnonzero(np.diff((np.cumsum(size) - size) // POOL)) + 1
    for start, end in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows], strict=True):
        yield batch.slice(start, end - start)


def identify(docs: DataFrame, model: tuple[list[str], BiGru] | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default), lang_pred, score and positions: how many
    positions of the text have each language's label.  Columns of these names give way."""
    new = ("lang_pred", "score", "positions")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    source = docs.select(*kept, docs[text].alias("__text"))

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for rows in _pools(batch):
                texts = [t or "" for t in rows.column("__text").to_pylist()]
                has = [any(map(str.isalpha, t)) for t in texts]
                pred, score, positions = ["und"] * len(texts), np.zeros(len(texts)), [[]] * len(texts)
                if model:
                    languages, net = model
                    read = [t.encode() for t in texts]
                    sums, labels = pooled(net, read)
                    mean = sums / np.maximum([len(t) for t in read], 1)[:, None]
                    best = mean.argmax(axis=1)
                    pred = [languages[b] if h else "und" for b, h in zip(best, has, strict=True)]
                    score = np.where(has, mean[np.arange(len(best)), best], 0).clip(0, 1).round(6)
                    positions = [list(zip(languages, map(int, s), strict=True)) for s in labels]
                kind = pa.map_(pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(positions, kind)], names=[*kept, *new])

    return source.mapInArrow(run, extended(source.drop("__text").schema, "lang_pred string, score double, positions map<string, bigint>"))
