"""Language-model scoring: a causal self-attention model trained in numpy on subword ids.

The model predicts the class of the next subword from the subwords before it by one causal self-attention layer
and a small feed-forward layer; the subword within its class comes by its count in all training documents. The probability
of a word mixes three distributions over words: its count; its first subword by the model and then the word among
those that begin so, by counts; and its subwords in a row, each with the event that the word goes on or ends after it. So the
probabilities of all words, and of the end of the text, add up to 1 at most. Words never seen have the last of the three alone,
whose share is at least that of words seen once (Good and Turing's estimate of what is new).
Texts are scored in overlapping windows: every token is scored once, in the window that shows it the most
context, with the attention of many windows done as one masked batch.

The model learns from every place of every training document: in rounds, each of about twice as many chunks as the one
before, all chunks of a round go on from the model so far side by side, and their changes are averaged. Classes come from neighbours counted over
all training documents. Word counts come by way of tally: nothing that grows with the corpus is broadcast, and what crosses
the network follows the corpus.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean_memory
from .tally import ASKED, answered, chunk_count, dealt, packed, question, ranges_for, unpacked, whole_answer
from .tokens import default_tokenizer, ragged, word_encoder
from .words import grouped, hashed_words, new_seed

#: Key of the end token in the tally of words.
_END = np.uint64(0x5DEECE66D1CE4E5B)
#: Shares of a word by its count, by its count given its first subword, and by its subwords in a row; the last grows where more is new.
SHARES = (0.35, 0.45, 0.2)


def turned(a: np.ndarray) -> np.ndarray:
    """A copy with the last two axes exchanged: products of small matrices are faster with it than with a view."""
    return np.ascontiguousarray(a.swapaxes(-1, -2))


def over_windows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum over all rows of all windows of the outer products of a's and b's."""
    k = math.gcd(len(a) * a.shape[1], 256)
    return (a.reshape(-1, k, a.shape[2]).transpose(0, 2, 1) @ b.reshape(-1, k, b.shape[2])).sum(0)


class Attention:
    """Parameters and both passes of the model; x are windows of input ids, y the classes that follow."""

    def __init__(self, n_ids: int, n_classes: int, class_of: np.ndarray, width: int = 16, window: int = 32, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.width, self.window, self.class_of, self.n_classes = width, window, class_of, n_classes

        def init(*shape: int) -> np.ndarray:
            return rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)

        self.p = {
            "embed": rng.normal(0, 0.3, (n_ids + 1, width)).astype(np.float32), "place": rng.normal(0, 0.1, (window, width)).astype(np.float32),
            "qv": init(width, 2 * width), "up": init(width, 2 * width), "down": init(2 * width, width), "top": init(width, n_classes),
        }
        self.ceiling = np.where(np.tri(window, dtype=bool), np.float32(60), np.float32(-1e9))  # exponents are held to 60, and none reaches ahead

    def attend(self, x: np.ndarray, skip: int = 0) -> tuple:
        """What stands at each place of windows x (n, window) from skip on after both layers, by row, and what it came from.

        With one head, keys may be the inputs themselves and values need no second product. Attention is divided by
        its sum after it is applied, and sums are taken by matrix products. Products are taken window by window, which small
        matrices are faster in, and what is above 0 is told by the sign bit.
        """
        p, w = self.p, self.width
        n, t = x.shape
        e = p["embed"].take(x, 0)
        e += p["place"][:t]
        qv = e @ p["qv"]
        a = qv[:, skip:, :w] @ turned(e)
        np.minimum(a, self.ceiling[skip:t, :t], out=a)
        np.exp(a, out=a)
        with_one = np.empty((n, t, w + 1), e.dtype)
        with_one[..., w] = 1
        with_one[..., :w] = qv[..., w:]
        c = a @ with_one
        share = 1 / c[..., w:]
        c = c[..., :w] * share
        h = e[:, skip:] + c
        u = h @ p["up"]
        bits = u.view(f"i{u.itemsize}")
        above = ~(bits >> (8 * u.itemsize - 1))
        bits &= above
        g = u @ p["down"]
        g += h
        return g.reshape(-1, w), u, h, c, share, a, qv, e, above

    def odds(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the classes after each place: their odds, and the sum of these."""
        with np.errstate(over="ignore"):
            s = (g.reshape(-1, math.gcd(len(g), 128), self.width) @ self.p["top"]).reshape(len(g), -1)
            np.exp(s, out=s)
            total = s @ np.ones(s.shape[1], s.dtype)
        if not np.isfinite(total).all():
            s = np.exp(np.minimum(g @ self.p["top"], 60))
            total = s @ np.ones(s.shape[1], s.dtype)
        return s, total

    def log_of(self, x: np.ndarray, y: np.ndarray, skip: int = 0) -> np.ndarray:
        """Log probabilities of the classes y (n, window - skip) after the places of x from skip on, by row."""
        s, total = self.odds(self.attend(x, skip)[0])
        return np.log(np.maximum(s.reshape(-1).take(np.arange(0, s.size, s.shape[1]) + y.reshape(-1)), 1e-30) / total)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict:
        """Gradients of the mean loss; places whose class is below 0 have none."""
        p, w = self.p, self.width
        g, u, h, c, share, a, qv, e, above = self.attend(x)
        n, t = x.shape
        kind = e.dtype.type
        y = y.reshape(-1)
        s, total = self.odds(g)
        s.reshape(-1)[np.arange(0, s.size, s.shape[1]) + np.maximum(y, 0)] -= total
        part = ((y >= 0) / max(1, int((y >= 0).sum())) / total).astype(kind).reshape(n, t, 1)  # by row, s times this is the gradient
        s = s.reshape(n, t, -1)
        grad: dict = {"top": over_windows(g.reshape(n, t, w) * part, s)}
        dh = s @ turned(p["top"])
        dh *= part
        grad["down"] = over_windows(u, dh)
        du = dh @ turned(p["down"])
        du.view(above.dtype)[...] &= above
        grad["up"] = over_windows(h, du)
        dh += du @ turned(p["up"])
        dc = dh * share
        dqv = np.empty((n, t, 2 * w), kind)
        np.matmul(a.transpose(0, 2, 1), dc, out=dqv[..., w:])
        da = dc @ turned(qv[..., w:])
        da -= np.einsum("ijk,ijk->ij", dc, c)[..., None]
        da *= a
        np.matmul(da, e, out=dqv[..., :w])
        dh += da.transpose(0, 2, 1) @ qv[..., :w]
        grad["qv"] = over_windows(e, dqv)
        dh += dqv @ turned(p["qv"])
        grad["place"] = np.zeros_like(p["place"])
        grad["place"][:t] = dh.reshape(n, t * w).sum(0).reshape(t, w)
        ids = x.reshape(-1).astype(np.uint16) if len(p["embed"]) <= 1 << 16 else x.reshape(-1)  # 16 bits sort in linear time
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        rows = dh.reshape(-1, w).take(order, 0)
        rows = rows if w % 2 else rows.view(np.result_type(kind, np.complex64))  # two numbers are added up at once
        grad["embed"] = (ids[at].astype(np.int64), np.add.reduceat(rows, at).view(kind))
        return grad

    def train(self, x: np.ndarray, y: np.ndarray, least_steps: int = 1, rate: float = 4e-3, batch: int = 96, seed: int = 6) -> None:
        """Adam over all windows x and the ids y that follow (below 0: none), in random order, as often as least_steps need, once at least."""
        rng = np.random.default_rng(seed)
        embed, names = self.p["embed"], [k for k in self.p if k != "embed"]
        dense = np.concatenate([self.p[k].reshape(-1) for k in names])
        for k, part in zip(names, np.split(dense, np.cumsum([self.p[k].size for k in names])), strict=False):
            self.p[k] = part.reshape(self.p[k].shape)  # a view: all but ids' vectors are moved as one
        (m, s), (m_ids, s_ids) = np.zeros((2, *dense.shape), dense.dtype), np.zeros((2, *embed.shape), embed.dtype)

        def move(m: np.ndarray, s: np.ndarray, g: np.ndarray) -> np.ndarray:
            m *= 0.9
            m += 0.1 * g
            s *= 0.98
            s += 0.02 * g * g
            return now * m / (np.sqrt(s) + 1e-7)

        a_pass = -(-len(x) // batch)
        steps = a_pass * max(1, -(-least_steps // max(1, a_pass)))
        for step in range(1, steps + 1):
            if (step - 1) % a_pass == 0:
                order = rng.permutation(len(x))
            at = order[(step - 1) % a_pass * batch :][:batch]
            inputs, ids = x.take(at, 0), y.take(at, 0)
            classes = np.where(ids < 0, -1, self.class_of[ids])
            now = rate * min(1.0, step / 30) * (1 - 0.9 * step / steps)
            grad = self.gradients(inputs, classes)
            at, g = grad["embed"]
            mean, square = m_ids.take(at, 0), s_ids.take(at, 0)
            embed[at] = embed.take(at, 0) - move(mean, square, g)
            m_ids[at], s_ids[at] = mean, square
            dense -= move(m, s, np.concatenate([grad[k].reshape(-1) for k in names]))

    def class_log10(self, ids: np.ndarray, bounds: np.ndarray, stride: int = 28, batch: int = 96) -> np.ndarray:
        """log10 P(class) of every id, given the ids before it in its row (rows: bounds[k] to bounds[k + 1], none empty).

        A window of inputs starts at every stride-th place of a row; a place is scored in the last window in which
        at least window - stride inputs come before it, or in the row's first.
        """
        w, back = self.window, self.window - stride
        n = np.diff(bounds)
        inputs = np.empty(len(ids), np.int64)
        inputs[1:] = ids[:-1]
        inputs[bounds[:-1]] = self.p["embed"].shape[0] - 1
        per_row = np.maximum(1, -(-(n - back) // stride))
        row = np.repeat(np.arange(len(n)), per_row)
        k = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        start, stop = bounds[row] + k * stride, bounds[row + 1]
        classes, out, spots = self.class_of[ids], np.empty(len(ids), np.float32), np.arange(w)
        ends = start + w > stop
        for which, skip, ends in ((k == 0) & ~ends, 0, False), ((k == 0) & ends, 0, True), ((k > 0) & ~ends, back, False), ((k > 0) & ends, back, True):  # only the places that are used
            which = np.flatnonzero(which)
            for lo in range(0, len(which), batch):
                some = which[lo : lo + batch]
                at = start[some, None] + spots
                inside = np.minimum(at, len(ids) - 1) if ends else at
                z = self.log_of(inputs.take(inside), classes.take(inside[:, skip:]), skip)
                at = at[:, skip:]
                if ends:
                    use = at < stop[some, None]
                    at, z = at[use], z[use.reshape(-1)]
                out[at.reshape(-1)] = z
        return out / np.float32(np.log(10))


class Words:
    """Probabilities of words by the model and by what was counted over all training texts.

    subword, heads and lasts count how often an id occurs, begins a word and ends one; tokens counts all words and ends, once
    those that were seen once.
    """

    def __init__(self, model: Attention, subword: np.ndarray, heads: np.ndarray, lasts: np.ndarray, tokens: int, once: int):
        self.model, self.heads, self.tokens = model, np.maximum(heads, 1), max(1, tokens)
        last = min(0.5, max(SHARES[2], once / self.tokens))
        self.shares = [(1 - last) * x / sum(SHARES[:2]) for x in SHARES[:2]] + [last]
        self.empty = 1 / (tokens + 2)  # of the last share: words of which the tokenizer leaves nothing
        mass = subword + 0.5
        self.within = np.log10(mass / np.bincount(model.class_of, mass, model.n_classes)[model.class_of])
        ends = (lasts + 0.5) / (subword + 1)
        self.goes_on, self.stops = np.log10(1 - ends), np.log10(ends)
        self.stops[-1] = 0.0  # the end of a text needs no other event

    def log10(self, ids: np.ndarray, size: np.ndarray, first: np.ndarray, times: np.ndarray) -> np.ndarray:
        """log10 probabilities of words: they have size ids each and were seen times; rows begin at words first[k] (the last bound included) and have an end, so some id."""
        words = np.concatenate([[0], np.cumsum(size)])
        each = self.model.class_log10(ids, words[first]) + self.within[ids]
        full = np.flatnonzero(size)
        stop = words[1:][full] - 1
        event = self.goes_on[ids]
        event[stop] = self.stops[ids[stop]]
        total = np.concatenate([[0], np.cumsum(each + event)])
        spelled = np.full(len(size), np.log10(self.empty))
        spelled[full] = total[stop + 1] - total[words[:-1][full]] + np.log10(1 - self.empty)
        seen = self.shares[0] * times / self.tokens
        head = words[:-1][full]
        seen[full] += self.shares[1] * 10 ** each[head] * times[full] / self.heads[ids[head]]
        some = seen > 0
        out = np.log10(self.shares[2]) + spelled
        out[some] = np.log10(seen[some] + 10 ** out[some])
        return out


def hubs_of(count: np.ndarray) -> np.ndarray:
    """The place of each id among the 128 commonest, or -1."""
    hubs = np.argsort(-count, kind="stable")[:128]
    hub = np.full(len(count), -1)
    hub[hubs] = np.arange(len(hubs))
    return hub


def neighbours(ids: np.ndarray, hub: np.ndarray) -> np.ndarray:
    """A place in a table of 256 columns an id for each neighbour in a row of ids that is a hub: those after an id, then those before it."""
    of = hub[ids]
    right, left = np.flatnonzero(of[1:] >= 0), np.flatnonzero(of[:-1] >= 0)
    return np.concatenate([ids[right] * 256 + of[right + 1], ids[left + 1] * 256 + of[left] + 128])


def classes_by(count: np.ndarray, table: np.ndarray, n_classes: int = 64, seed: int = 7) -> np.ndarray:
    """A class for each id: k-means over what stands before and after it (table, as of neighbours()); ids not seen share class 0."""
    seen = np.flatnonzero(count)
    table = table[seen]
    table /= np.maximum(table.sum(1, keepdims=True), 1)
    np.sqrt(table, out=table)
    table = np.hstack([table, 0.15 * np.log1p(count[seen])[:, None].astype(np.float32)])
    rng = np.random.default_rng(seed)
    weight = np.sqrt(count[seen]).astype(np.float32)
    k = min(n_classes - 1, len(seen))
    centre = table[rng.choice(len(seen), k, False, weight / weight.sum())] if k else table[:0]
    of = np.zeros(len(seen), np.int64)
    for _ in range(8 if k else 0):
        of = np.argmax(table @ centre.T - 0.5 * (centre**2).sum(1), 1)
        for c in range(k):
            own = np.flatnonzero(of == c)
            if len(own):
                centre[c] = weight[own] @ table[own] / weight[own].sum()
    out = np.zeros(len(count), np.int64)
    out[seen] = of + 1
    return out


def joined(*parts: bytes) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def parted(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def training_rows(note: bytes, end_id: int, ordered: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of a chunk's training texts, whole, each with its end; ordered: in an order that follows from the texts alone."""
    count, spread, place, n, train, *_ = parted(note)
    size = np.append(unpacked(count, np.uint32).astype(np.int64), 1)
    pool, n, train = np.append(unpacked(spread, np.uint16), np.uint16(end_id)), unpacked(n, np.uint32).astype(np.int64), np.frombuffer(train, bool)
    own = np.insert(unpacked(place, np.uint32).astype(np.int64), np.cumsum(n), len(size) - 1)[np.repeat(train, n + 1)]
    ids, bounds = ragged(pool, (np.cumsum(size) - size)[own], size[own], np.concatenate([[0], np.cumsum(n[train] + 1)]))
    if not ordered:
        return ids.astype(np.int64), bounds
    order = np.argsort([xxhash.xxh3_64_intdigest(ids[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], kind="stable")
    n = np.diff(bounds)[order]
    ids, bounds = ragged(ids, bounds[:-1][order], n, np.arange(len(n) + 1))
    return ids.astype(np.int64), bounds


def training_windows(ids: np.ndarray, bounds: np.ndarray, start: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): every id once in y, with the inputs of its row before it in x; y is -1 beyond a row's end."""
    inputs = np.empty(len(ids), np.int64)
    inputs[1:] = ids[:-1]
    inputs[bounds[:-1]] = start
    per_row = -(-np.diff(bounds) // window)
    row = np.repeat(np.arange(len(per_row)), per_row)
    k = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    at = (bounds[row] + k * window)[:, None] + np.arange(window)
    inside = at < bounds[row + 1][:, None]
    at = np.minimum(at, max(0, len(ids) - 1))
    return inputs[at].astype(np.int32), np.where(inside, ids[at], -1).astype(np.int32)


#: Slices that a sum over the corpus is cut into, and parts that are added up in one go.
_SLICES, _AT_ONCE = 16, 64
_PARTS = "_slice int, _part int, _sum binary"


def sliced(part: int, vectors: list[np.ndarray], kind: type = np.float64) -> pa.RecordBatch:
    """A part of a sum, cut into vectors, as numbers of a kind."""
    n = len(vectors)
    columns = [pa.array(range(n), pa.int32()), pa.array([part] * n, pa.int32()), pa.array([packed(v.astype(kind)) for v in vectors], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["_slice", "_part", "_sum"])


def summed(parts: DataFrame, n_parts: int, kind: type = np.float64) -> list[np.ndarray]:
    """Per slice, the sum of its parts (of a kind, numbered below n_parts), always in the same order, some at a time; no parts: no slices."""

    def adder(kind: type) -> Callable[[pa.Table], pa.Table]:
        def add(table: pa.Table) -> pa.Table:
            lean_memory()
            total: np.ndarray | float = np.float64(0)
            for k in np.argsort(table.column("_part").to_numpy()):
                total = total + unpacked(table.column("_sum")[int(k)].as_py(), kind)
            part = table.column("_part")[0].as_py() // _AT_ONCE
            return pa.table([table.column("_slice")[:1], pa.array([part], pa.int32()), pa.array([packed(total)], pa.binary())], ["_slice", "_part", "_sum"])

        return add

    while True:
        parts = parts.groupBy("_slice", F.floor(F.col("_part") / _AT_ONCE)).applyInArrow(adder(kind), _PARTS)
        if n_parts <= _AT_ONCE:
            break
        n_parts, kind = -(-n_parts // _AT_ONCE), np.float64
    return [unpacked(r["_sum"], np.float64) for r in sorted(parts.collect())]  # of the size of a model or a table of neighbours


def round_of(chunk: int) -> int:
    """The round in which a chunk is learned: 0 the first chunk, 1 the next seven, and from then on as many as in all rounds before."""
    return max(1, chunk.bit_length() - 2) if chunk else 0


def learned(asked: DataFrame, chunks: int, n_ids: int, steps: int, counts: np.ndarray) -> Attention:
    """A model from all training texts, by the chunks' notes (_round, _note); counts: of all ids.

    Classes come from neighbours counted over all chunks. The first chunk is learned from the start, in steps
    steps or more; then, round by round, each chunk goes on from the model so far with all its windows, once,
    and the changes are averaged: an id's vector by how often the chunks have it, all else by windows.
    """
    end_id, spark = n_ids - 1, asked.sparkSession
    slices = [n_ids * k // _SLICES for k in range(_SLICES + 1)]
    hub = hubs_of(counts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        total = np.zeros(n_ids * 256, np.uint32)
        for batch in batches:
            for note in batch.column(0):
                ids, _ = training_rows(note.as_py(), end_id, ordered=False)
                np.add.at(total, neighbours(np.append(end_id, ids), hub), np.uint32(1))
        yield sliced(TaskContext.get().partitionId(), [total[a * 256 : b * 256] for a, b in zip(slices[:-1], slices[1:], strict=True)], np.uint32)

    notes = [asked.where(F.col("_round") == r).select("_note") for r in range(round_of(chunks - 1) + 1)]
    every = asked.where("_round >= 0").select("_note")
    table = np.zeros((n_ids, 256), np.float32)
    got = summed(every.mapInArrow(count, _PARTS), every.rdd.getNumPartitions(), np.uint32)
    for a, b, part in zip(slices[:-1], slices[1:], got, strict=False):
        table[a:b] = part.reshape(-1, 256)
    model = Attention(n_ids, 64, classes_by(counts, table))
    del table, got
    dense = [k for k in model.p if k != "embed"]

    def learn(r: int) -> list[np.ndarray]:
        """Sums over the chunks of round r: slices of changes of ids' vectors and their weights, then of all else."""
        shared = spark.sparkContext.broadcast(model)  # a model of fixed size

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lean_memory()
            was: Attention = shared.value
            ids, rest = np.zeros((n_ids + 1, was.width + 1)), 0.0
            for batch in batches:
                for note in batch.column(0):
                    mine = copy.deepcopy(was)
                    x, y = training_windows(*training_rows(note.as_py(), end_id), n_ids, mine.window)
                    mine.train(x, y, *((steps, 4e-3) if r == 0 else (1, 1.5e-3)))
                    weight = np.bincount(x.reshape(-1), minlength=n_ids + 1)
                    some = np.flatnonzero(weight)
                    ids[some, :-1] += (mine.p["embed"][some] - was.p["embed"][some]) * weight[some, None]
                    ids[some, -1] += weight[some]
                    rest = rest + np.append(np.concatenate([(mine.p[k] - was.p[k]).reshape(-1) for k in dense]) * np.float64(len(x)), len(x))
            if np.ndim(rest):
                yield sliced(TaskContext.get().partitionId(), [*(part.reshape(-1) for part in np.array_split(ids, _SLICES)), rest], np.float32)

        return summed(notes[r].mapInArrow(work, _PARTS), notes[r].rdd.getNumPartitions(), np.float32)

    for r in range(len(notes)):
        *ids, rest = learn(r) or (None,)
        if rest is None:
            continue
        ids = np.concatenate(ids).reshape(n_ids + 1, -1)
        model.p["embed"] = (model.p["embed"] + ids[:, :-1] / np.maximum(ids[:, -1:], 1)).astype(np.float32)
        at, rest = 0, rest[:-1] / max(1, rest[-1])
        for k in dense:
            p = model.p[k]
            model.p[k] = (p + rest[at : at + p.size].reshape(p.shape)).astype(np.float32)
            at += p.size
    return model


def lm_score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, tokenizer: str | None = None,
    steps: int = 1500, chunk_bytes: int = 8 << 20, learn: bool = True,
) -> DataFrame:
    """A row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (the last only if learn: the others need no model).

    Training rows are those whose crc32(id as text) mod folds is not fold; the attention layers and the classes of subwords learn
    from all of them, whole (steps: the least training steps on the first chunk), as word and subword counts do. n_tokens counts words (ASCII case folded) and
    one end a text; base_score is their add-one unigram log10 probability, score the model's log10 probability of the text's
    words and its end. A null text is the empty text (one token, its end); a null id counts as the empty
    text in the fold and stays null; repeated rows count and are scored each; an empty table gives an empty
    result. Texts are scored whole.
    """
    path = tokenizer or default_tokenizer()
    n_ids = word_encoder(path).size if learn else 1
    end_id, word_seed = n_ids - 1, new_seed()
    chunks = chunk_count(docs, text_col, chunk_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    scratch = Scratch(docs.sparkSession, "lm")
    ranges = ranges_for(chunks)

    def is_held(ids: pa.ChunkedArray) -> np.ndarray:
        return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % folds == fold for x in ids.to_pylist()], bool)

    def asking(table: pa.Table) -> pa.Table:
        lean_memory()
        hashes, starts, ends, first, data = hashed_words(table.column("_text").combine_chunks(), seed=word_seed)
        distinct, index, place = grouped(hashes)
        train = ~is_held(table.column("_id"))
        own = np.bincount(place[np.repeat(train, np.diff(first))], minlength=len(distinct))
        texts = int(train.sum())
        count, spread, ids = np.zeros(0, np.int64), np.zeros(0, np.uint16), [np.zeros(0)]
        if learn:
            encoder = word_encoder(path)
            begin, count = encoder.look_up(distinct, starts[index], ends[index], data)
            spread, at = ragged(encoder.pool.part(), begin, count, np.arange(len(distinct) + 1))
            some = at[1:] > at[:-1]
            ids = [np.bincount(x, y.astype(float), n_ids) for x, y in ((spread, np.repeat(own, np.diff(at))), (spread[at[:-1][some]], own[some]), (spread[at[1:][some] - 1], own[some]))]
            for x in ids:
                x[end_id] += texts
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("_id", table.schema.field("_id").type)])) as writer:
            writer.write_table(table.select(["_id"]))
        end = int(np.searchsorted(distinct, _END))
        note = joined(  # so that neither training nor use needs texts or a tokenizer
            packed(count.astype(np.uint32)), packed(spread), packed(place.astype(np.uint32)), packed(np.diff(first).astype(np.uint32)), train.tobytes(), sink.getvalue().to_pybytes(), end.to_bytes(8, "little")
        )
        chunk = table.column("_chunk")[0].as_py()
        rows = question(chunk, np.insert(distinct, end, _END), np.insert(own, end, texts), ranges)
        rows = rows.append_column("_note", pa.nulls(ranges, pa.binary())).append_column("_ids", pa.nulls(ranges, pa.binary())).append_column("_round", pa.array([-1] * ranges, pa.int32()))
        last = [[-1], [chunk], [None], [None], [note], [packed(np.concatenate(ids).astype(np.uint32))], [round_of(chunk)]]
        return pa.concat_tables([rows, pa.table([pa.array(x, t) for x, t in zip(last, rows.schema.types, strict=True)], rows.column_names)])

    asked = dealt(docs, id_col, text_col, chunks).groupBy("_chunk").applyInArrow(asking, f"{ASKED}, _note binary, _ids binary, _round int")
    asked = scratch.save(asked, "asked", by="_round")
    got = answered(asked.where("_round = -1").select("_range", "_chunk", "_keys", "_counts"), chunks)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | float = 0.0
        for batch in batches:
            for x in batch.column(0):
                total = total + unpacked(x.as_py(), np.uint32).astype(np.float64)
        if np.ndim(total):
            yield sliced(TaskContext.get().partitionId(), [total])

    shared = None
    if learn:
        of_chunks = asked.where("_round >= 0").select("_ids")
        sums = summed(of_chunks.mapInArrow(add_up, _PARTS), of_chunks.rdd.getNumPartitions())
        counts = sums[0].astype(np.int64).reshape(3, n_ids) if sums else np.zeros((3, n_ids), np.int64)
        shared = docs.sparkSession.sparkContext.broadcast((learned(asked, chunks, n_ids, steps, counts[0]), counts))  # a model and a few counts an id

    def use(notes: pa.Table, answers: pa.Table) -> pa.Table:
        lean_memory()
        whole, (n_words, once, tokens) = whole_answer(answers)
        whole = whole.astype(np.int64)
        count, pool, place, n, train, ids, at_end = parted(notes.column("_note")[0].as_py())
        table = pa.ipc.open_stream(ids).read_all()
        count, pool, place = unpacked(count, np.uint32).astype(np.int64), unpacked(pool, np.uint16), unpacked(place, np.uint32).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(unpacked(n, np.uint32), dtype=np.int64)])
        at_end = int.from_bytes(at_end, "little")
        end, word = int(whole[at_end]), np.delete(whole, at_end)
        n = np.diff(first)
        known = sums_of(word > 0, place, first) + (end > 0)
        base = sums_of(np.log10(word + 1.0), place, first) + np.log10(end + 1.0) - (n + 1) * np.log10(tokens + n_words + 1)
        columns = [pa.array(~np.frombuffer(train, bool)), pa.array(n + 1), pa.array(known), pa.array(np.full(len(n), tokens)), pa.array(base)]
        if shared is None:
            return pa.table([table.column("_id"), *columns], [id_col, *names])
        attention, (subword, heads, lasts) = shared.value
        words = Words(attention, subword, heads, lasts, tokens, once)
        pool = np.append(pool, np.uint16(end_id))
        size, times = np.append(count, 1), np.append(word, end)  # the last stands for an end
        begin = np.cumsum(size) - size
        score = np.empty(len(n))
        rows = np.arange(len(n))
        while len(rows):  # some ten thousand words at a time
            some = rows[: max(1, int(np.searchsorted(np.cumsum(n[rows]), 30_000)))]
            rows = rows[len(some) :]
            a = first[some[0]]
            at = first[some[0] : some[-1] + 2] - a
            own = np.insert(place[a : first[some[-1] + 1]], at[1:], len(size) - 1)
            at = at + np.arange(len(at))
            ids, _ = ragged(pool, begin[own], size[own], at)
            sure = np.concatenate([[0], np.cumsum(words.log10(ids.astype(np.int64), size[own], at, times[own]))])
            score[some] = sure[at[1:]] - sure[at[:-1]]
        return pa.table([table.column("_id"), *columns, pa.array(score)], [id_col, *names])

    names = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", *["score"] * learn)
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double" + ", score double" * learn
    notes = asked.where("_round >= 0").select("_chunk", "_note").repartition(chunks, "_chunk")
    return notes.groupBy("_chunk").cogroup(got.repartition(chunks, "_chunk").groupBy("_chunk")).applyInArrow(use, schema)


def sums_of(of_distinct: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row, the sum of of_distinct over its words; each row is added up by itself, so that long chunks cost no digits."""
    n = np.diff(first)
    out = np.zeros(len(n), np.result_type(of_distinct, np.int64))
    some = np.flatnonzero(n)
    if len(some):
        out[some] = np.add.reduceat(of_distinct[place].astype(out.dtype), first[some])
    return out
