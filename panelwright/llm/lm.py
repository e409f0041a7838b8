"""LM scoring: a causal self-attention model on subword ids, trained in numpy by averaged local descent."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import bpe
from panelwright.llm.codec import encode_words, ragged
from panelwright.llm.quality_gam import fold
from panelwright.llm.runtime import checkpoint, map_arrow, slices, texts
from panelwright.llm.simhash import _LOWER

#: Subwords: the byte alphabet and the first merges of the public tokenizer; the last id ends a text.
VOCABULARY, WIDTH = 2_048, 16
END, PAD = VOCABULARY - 1, VOCABULARY
MERGES = VOCABULARY - 257
#: A window of 32 inputs scores its last 24: each token is scored once, with the 9 to 32 tokens before it.
WINDOW, STEP = 32, 24
#: The softmax has two levels: 32 classes of 64 subwords.
CLASSES, MEMBERS = 32, 64
#: Rounds of local descent, each over all windows of its own part of the training documents.
ROUNDS, BATCH = 3, 192
#: Words that are one in so many of the training corpus or more (no more than that many can be) have
#: their counts on every executor; counts of rarer words are joined.
HEAD_SHARE = 1 << 19

_SHAPES = {
    "embed": (VOCABULARY + 1, WIDTH), "place": (WINDOW, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH), "direct": (WIDTH, WIDTH),
    "shift": (WIDTH,), "of_class": (WIDTH, CLASSES), "class_bias": (CLASSES,), "of_member": (CLASSES, WIDTH, MEMBERS), "member_bias": (CLASSES, MEMBERS),
}
_SIZES = {k: int(np.prod(s)) for k, s in _SHAPES.items()}


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    parts = np.split(flat, np.cumsum([*_SIZES.values()])[:-1])
    return {k: x.reshape(s) for (k, s), x in zip(_SHAPES.items(), parts, strict=True)}


@dataclass
class Model:
    """Weights in one vector, and each subword's class and place in it.

    A class uses its first ``width`` places. The last of them stands for all subwords of the class
    that training doesn't have (nothing tells them apart), one for one with equal parts:
    ``part`` is the logarithm of a subword's part of its place.
    """

    flat: np.ndarray
    class_of: np.ndarray
    member_of: np.ndarray
    width: int
    part: np.ndarray


def initial(counts: np.ndarray, seed: int = 7) -> Model:
    """Biases from the counts of subwords, so that the untrained model is the smoothed unigram; the rest small and random."""
    rank = np.empty(VOCABULARY, np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(VOCABULARY)
    last = min(MEMBERS - 1, -(-int((counts > 0).sum()) // CLASSES))
    class_of, member_of = rank % CLASSES, np.minimum(rank // CLASSES, last)
    rng = np.random.default_rng(seed)
    flat = rng.normal(0, 0.1, sum(_SIZES.values())).astype(np.float32)
    w = unpack(flat)
    share = (counts + 0.5) / (counts.sum() + 0.5 * VOCABULARY)
    mass = np.zeros((CLASSES, MEMBERS))
    np.add.at(mass, (class_of, member_of), share)
    w["class_bias"][:] = np.log(mass.sum(axis=1))
    w["member_bias"][:, : last + 1] = np.log(mass[:, : last + 1] / mass.sum(axis=1, keepdims=True))
    w["of_class"][:] *= 0.1
    w["of_member"][:] *= 0.1
    w["shift"][:] = 0
    return Model(flat, class_of, member_of, last + 1, np.where(member_of == last, -np.log(MEMBERS - last), 0.0))


#: Terms within these bounds go through a softmax without each row's largest one subtracted.
SAFE = 60.0


def _softmax(x: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
    """Softmax of each row, in place, over the terms in ``seen`` if given; a row that sees none is zero."""
    if x.size and not max(x.max(), -x.min()) < SAFE:
        if seen is not None:
            np.copyto(x, np.float32(-1e9), where=~seen)
        x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    if seen is not None:
        x *= seen
    total = x @ np.ones(x.shape[-1], x.dtype)
    x *= (1 / np.maximum(total, np.finfo(x.dtype).tiny))[..., None]
    return x


def _attend(x: np.ndarray, inputs: np.ndarray, at: int, safe: bool | None = None) -> tuple[np.ndarray, ...]:
    """Keys, values, queries, terms of the attention, one over their sums, means of values and hidden states.

    ``x`` has keys, values, queries and the direct part of every place side by side; queries and what
    follows begin at place ``at``. Terms have no part behind their place and at padding, and are not
    divided by their sums here: the means are.
    """
    k, v, q, d = x[..., :WIDTH], x[..., WIDTH : 2 * WIDTH], x[:, at:, 2 * WIDTH : 3 * WIDTH], x[:, at:, 3 * WIDTH :]
    terms = q @ k.transpose(0, 2, 1)
    behind = np.tri(WINDOW, dtype=bool)[at:]
    if not (max(terms.max(initial=0), -terms.min(initial=0)) < SAFE if safe is None else safe):
        terms -= np.where(behind & (inputs != PAD)[:, None, :], terms, -np.inf).max(axis=-1, keepdims=True)
        np.minimum(terms, 0, out=terms)
    np.exp(terms, out=terms)
    terms *= behind.astype(x.dtype)
    padded = np.flatnonzero((inputs == PAD).any(axis=1))
    if len(padded):
        terms[padded] *= (inputs[padded] != PAD)[:, None, :]
    over = 1 / np.maximum(terms @ np.ones(WINDOW, x.dtype), np.finfo(x.dtype).tiny)[..., None]
    mean = terms @ v
    mean *= over
    return k, v, q, terms, over, mean, np.tanh(mean + d)


def _sides(w: dict[str, np.ndarray]) -> np.ndarray:
    """What makes keys, values, queries (scaled) and the direct part of an input, side by side."""
    return np.concatenate([w["key"], w["value"], w["query"] * w["query"].dtype.type(WIDTH**-0.5), w["direct"]], axis=1)


def _by_class(model: Model, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, slice]]]:
    """Places of the targets that aren't padding, a class's together; the targets there, their classes, and the part of each class."""
    kinds = np.append(model.class_of, CLASSES).astype(np.int16)[targets]
    order = np.argsort(kinds, kind="stable")  # of 16 bits: a radix sort
    bounds = np.searchsorted(kinds[order], np.arange(CLASSES + 1)).tolist()
    order = order[: bounds[-1]]
    return order, targets[order], kinds[order], [(c, slice(a, b)) for c, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if a < b]


def _with_one(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``h[rows]`` with a one after each, which meets the biases."""
    out = np.ones((len(rows), WIDTH + 1), h.dtype)
    out[:, :WIDTH] = np.take(h, rows, axis=0)
    return out


def _outputs(model: Model, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of both levels of the softmax over the places in use, the biases below them."""
    n = model.width
    return np.concatenate([w["of_class"], w["class_bias"][None]]), np.concatenate([w["of_member"][..., :n], w["member_bias"][:, None, :n]], axis=1)


def _members(h: np.ndarray, of_member: np.ndarray, parts: list[tuple[int, slice]]) -> np.ndarray:
    out = np.empty((len(h), of_member.shape[2]), h.dtype)
    for c, rows in parts:
        np.matmul(h[rows], of_member[c], out=out[rows])
    return out


def _less_targets(p: np.ndarray, target: np.ndarray) -> float:
    """Takes one from each row's probability of its target, in place; the loss."""
    cells, flat = np.arange(len(p)) * p.shape[1] + target, p.reshape(-1)
    loss = -np.log(flat[cells] + 1e-30).sum()
    flat[cells] -= 1
    return loss


def gradient(model: Model, inputs: np.ndarray, targets: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss (nats a token) of windows, and its gradient; targets at padding don't count."""
    w, g_flat = unpack(model.flat), np.zeros_like(model.flat)
    g, kind = unpack(g_flat), model.flat.dtype
    scored = (targets != PAD).any(axis=0)
    at = int(scored.argmax()) if scored.any() else 0  # places before the first target are only looked at
    sides, m = _sides(w), len(inputs)
    x = np.take(w["embed"], inputs, axis=0)
    x += w["place"]
    made = (x.reshape(-1, WIDTH) @ sides).reshape(m, WINDOW, -1)
    made[..., 3 * WIDTH :] += w["shift"]
    k, v, q, terms, over, mean, h = _attend(made, inputs, at)
    order, t, kinds, parts = _by_class(model, targets[:, at:].ravel())
    n, hs = len(t), _with_one(h.reshape(-1, WIDTH), order)
    of_class, of_member = _outputs(model, w)
    p1, p2 = _softmax(hs @ of_class), _softmax(_members(hs, of_member, parts))
    loss = _less_targets(p1, kinds) + _less_targets(p2, model.member_of[t]) - model.part[t].sum()
    both = hs.T @ p1
    g["of_class"][:], g["class_bias"][:] = both[:WIDTH], both[WIDTH]
    back, more = p1 @ of_class.T, np.empty_like(hs)
    for c, rows in parts:
        both = hs[rows].T @ p2[rows]
        g["of_member"][c, :, : model.width], g["member_bias"][c, : model.width] = both[:WIDTH], both[WIDTH]
        np.matmul(p2[rows], of_member[c].T, out=more[rows])
    back += more
    hs *= hs
    back -= back * hs
    full = np.zeros((m * (WINDOW - at), WIDTH), kind)
    full[order] = back[:, :WIDTH]
    full = full.reshape(m, -1, WIDTH)
    d = np.zeros((m, WINDOW, 4 * WIDTH), kind)  # of keys, values, queries and the direct part
    d[:, at:, 3 * WIDTH :] = full
    full *= over
    dt = full @ v.transpose(0, 2, 1)
    dt -= np.einsum("ijk,ijk->ij", full, mean)[..., None]
    dt *= terms
    np.matmul(dt.transpose(0, 2, 1), q, out=d[..., :WIDTH])
    np.matmul(terms.transpose(0, 2, 1), full, out=d[..., WIDTH : 2 * WIDTH])
    np.matmul(dt, k, out=d[:, at:, 2 * WIDTH : 3 * WIDTH])
    d = d.reshape(-1, 4 * WIDTH)
    both = x.reshape(-1, WIDTH).T @ d
    g["key"][:], g["value"][:], g["query"][:], g["direct"][:] = np.split(both, 4, axis=1)
    g["query"][:] *= kind.type(WIDTH**-0.5)
    g["shift"][:] = np.ones(len(d), kind) @ d[:, 3 * WIDTH :]
    dx = d @ sides.T
    g["place"][:] = dx.reshape(m, WINDOW, WIDTH).sum(axis=0)
    flat = inputs.ravel().astype(np.int16)
    order = np.argsort(flat, kind="stable")  # a token's rows stand together and are added up at once
    flat = flat[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    g["embed"][flat[first]] = np.add.reduceat(np.take(dx, order, axis=0), first, axis=0)
    g_flat /= kind.type(max(1, n))
    return float(loss) / max(1, n), g_flat


def descend(model: Model, windows: Iterable[tuple[np.ndarray, np.ndarray]], rate: float) -> int:
    """Adam over batches of windows, in place; the number of tokens trained on."""
    first, second, move, tokens = np.zeros_like(model.flat), np.zeros_like(model.flat), np.empty_like(model.flat), 0
    for step, (inputs, targets) in enumerate(windows, 1):
        _, g = gradient(model, inputs, targets)
        np.subtract(g, first, out=move)
        move *= np.float32(0.1)
        first += move
        g *= g
        g -= second
        g *= np.float32(0.01)
        second += g
        np.multiply(second, np.float32(1 / (1 - 0.99**step)), out=move)
        np.sqrt(move, out=move)
        move += np.float32(1e-6)
        np.divide(first, move, out=move)
        move *= np.float32(rate / (1 - 0.9**step))
        model.flat -= move
        tokens += int((targets != PAD).sum())
    return tokens


class Scorer:
    """Scores token streams; what every subword and every place add to keys, values and queries is looked up instead of multiplied.

    Softmaxes are taken without their largest term subtracted where the weights bound all terms
    (``SAFE``), as they do for any model that training gives; else with it.
    """

    SAFE = 60.0

    def __init__(self, model: Model):
        self.model, w = model, unpack(model.flat.astype(np.float32))
        sides = _sides(w)
        self.token, self.place = w["embed"] @ sides, w["place"] @ sides
        self.place[:, 3 * WIDTH :] += w["shift"]
        self.of_class, self.of_member = _outputs(model, w)
        most = [np.sqrt((self.token[:, i : i + WIDTH] ** 2).sum(axis=1).max()) + np.sqrt((self.place[:, i : i + WIDTH] ** 2).sum(axis=1).max()) for i in (0, 2 * WIDTH)]
        outputs = max(np.abs(self.of_class).sum(axis=0).max(), np.abs(self.of_member).sum(axis=1).max())
        self.safe = bool(max(most[0] * most[1], outputs) < self.SAFE)

    def windows(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log probability of each target (0 at padding), for windows of inputs and the targets of their last places."""
        scores = np.zeros(targets.shape, np.float64)
        for i in range(0, len(targets), 256):
            self._some(inputs[i : i + 256], targets[i : i + 256].ravel(), scores[i : i + 256].reshape(-1))
        return scores

    def _some(self, inputs: np.ndarray, targets: np.ndarray, scores: np.ndarray) -> None:
        x = np.take(self.token, inputs, axis=0)
        x += self.place
        h = _attend(x, inputs, WINDOW - STEP, self.safe)[-1]
        order, t, kinds, parts = _by_class(self.model, targets)
        h = _with_one(h.reshape(-1, WIDTH), order)
        found = self._log(h @ self.of_class, kinds)
        found += self._log(_members(h, self.of_member, parts), self.model.member_of[t])
        scores[order] = found + self.model.part[t]

    def _log(self, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log of the softmax of each row at its target; ``x`` is used up."""
        if not self.safe:
            x -= x.max(axis=1, keepdims=True)
        picked = x.reshape(-1)[np.arange(len(x)) * x.shape[1] + target]
        np.exp(x, out=x)
        picked -= np.log(x @ np.ones(x.shape[1], x.dtype))
        return picked

    def score(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 probability of each text whose tokens (its end included) are ``ids[starts[i]:starts[i + 1]]``."""
        inputs, targets, owner = blocks(ids, starts)
        return np.bincount(owner, self.windows(inputs, targets).sum(axis=1), len(starts) - 1) / np.log(10)


def blocks(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows: ``inputs`` (n, WINDOW), ``targets`` of the last STEP places, and each window's text."""
    lengths, before = np.diff(starts), WINDOW - STEP + 1
    count = -(-lengths // STEP)
    ends = np.cumsum(before + count * STEP)  # each text stands behind padding and a start, up to a multiple of STEP
    begins = ends - count * STEP
    flat = np.full(int(ends[-1]) if len(ends) else 0, PAD, np.int16)
    flat[begins - 1] = END
    flat[np.arange(len(ids)) + np.repeat(begins - starts[:-1], lengths)] = ids
    owner = np.repeat(np.arange(len(lengths)), count)
    at = np.repeat(begins, count) + STEP * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
    if not len(at):
        return np.zeros((0, WINDOW), np.int16), np.zeros((0, STEP), np.int16), owner
    sliding = np.lib.stride_tricks.sliding_window_view
    return sliding(flat, WINDOW)[at - before], sliding(flat, STEP)[at], owner


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


_MARKS = (b".", b",", b";", b":", b"!", b"?")


class Subwords:
    """Encodes words with a blank before each, and gives each word's value in ``head``; remembers up to ``most`` of them."""

    def __init__(self, tokenizer: str, head: dict[bytes, float] | None = None, most: int = 400_000):
        self.model, self.head, self.most = bpe.load_part(tokenizer, MERGES), head or {}, most
        self._forget()

    def _forget(self) -> None:
        self.place, self.words = _Numbers(), []
        self.ids, self.starts, self.values = np.zeros(0, np.int16), np.zeros(1, np.int64), np.zeros(0)

    def rows(self, documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The number of every word of all documents, each closed by -1 for its end, and offsets."""
        if len(self.place) > self.most:
            self._forget()
        rows = np.fromiter(chain.from_iterable(chain(map(self.place.__getitem__, d), (-1,)) for d in documents), np.int64)
        new = [*islice(reversed(self.place), len(self.place) - len(self.words))][::-1]
        if new:
            ids, starts = self._merged(new)
            self.words += new
            self.ids, self.starts = np.concatenate([self.ids, ids.astype(np.int16)]), np.concatenate([self.starts, self.starts[-1] + starts[1:]])
            self.values = np.concatenate([self.values, np.array([self.head.get(w, np.nan) for w in new], float)])
        return rows, np.concatenate([[0], np.cumsum([len(d) + 1 for d in documents], dtype=np.int64)])

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of words. ASCII letters, also with a mark behind them, are one pre-token with their blank (the mark is its own)."""
        plain, others = [], []
        for i, w in enumerate(words):
            (plain if w.isalpha() or (w[-1:] in _MARKS and w[:-1].isalpha()) else others).append(i)
        stems = [words[i] for i in plain]
        marks = np.array([0 if w.isalpha() else w[-1] for w in stems], np.int64)
        ids, starts = self.model.merge([b" " + (w[:-1] if m else w) for w, m in zip(stems, marks.tolist(), strict=True)])
        marked = np.flatnonzero(marks)
        ids = np.insert(ids, starts[1:][marked], marks[marked])  # a byte is its own id
        starts = starts + np.concatenate([[0], np.cumsum(marks > 0)])
        more, more_starts = encode_words(self.model, [" " + words[i].decode() for i in others])
        order = np.empty(len(words), np.int64)
        order[plain + others] = np.arange(len(words))
        return ragged(np.concatenate([ids, more]), np.concatenate([starts, starts[-1] + more_starts[1:]]), order)

    def subwords(self, rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of all documents, each with its end, and offsets."""
        ids, starts = np.append(self.ids, np.int16(END)), np.append(self.starts, len(self.ids) + 1)
        flat, at = ragged(ids, starts, np.where(rows < 0, len(starts) - 2, rows))
        return flat, at[bounds]

    def encode(self, documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        return self.subwords(*self.rows(documents))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_LOWER).split()


@lru_cache(maxsize=2)
def _subwords(tokenizer: str) -> Subwords:
    return Subwords(tokenizer)


_valued: dict[str, Subwords] = {}


def _with_head(job: str, tokenizer: str, head: dict[bytes, float]) -> Subwords:
    """The words that this Python worker has met in a job."""
    if job not in _valued:
        _valued.clear()
        _valued[job] = Subwords(tokenizer, head)
    return _valued[job]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word, count)`` over all rows: A-Z lower-cased, runs without ASCII white space."""
    words = docs.select(F.explode(F.split(F.col(text), r"[\x20\x09-\x0D]+", -1)).alias("word")).where("word <> ''")
    lowered = F.translate(F.col("word"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # most words have no capital, which the plain function tells faster
    return words.select(F.when(F.lower("word") == F.col("word"), F.col("word")).otherwise(lowered).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


def _subword_counts(tokenizer: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = bpe.load_part(tokenizer, MERGES), np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            ids, starts = encode_words(model, [" " + w for w in batch.column("word").to_pylist()])
            np.add.at(held, ids, np.repeat(batch.column("count").to_numpy(zero_copy_only=False), np.diff(starts)))
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(held[there])], ["id", "count"])

    return run


def _streams(part: pa.RecordBatch, tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of the texts of a batch and offsets, from where they are kept (``ids``) or by encoding."""
    if "ids" not in part.schema.names:
        return _subwords(tokenizer).encode([words_of(t) for t in texts(part.column("_body"))])
    held = part.column("ids")
    starts = np.concatenate([[0], np.cumsum(pc.binary_length(held).to_numpy(zero_copy_only=False), dtype=np.int64)]) // 2
    return np.frombuffer(b"".join(held.to_pylist()), np.int16), starts


def _training(tokenizer: str, model: Model, rate: float, seed: int, column: str = "_body") -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: descends over the partition's windows and gives its weights, times its tokens, by place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = replace(model, flat=model.flat.copy())
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])

        def windows() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            held = np.zeros((2, 0, WINDOW), np.int16)
            for part in slices(batches, column):
                made = _windows(*_streams(part, tokenizer))
                held = np.concatenate([held, rng.permutation(made, axis=1)], axis=1)
                full = held.shape[1] // BATCH * BATCH
                for i in range(0, full, BATCH):
                    yield held[0, i : i + BATCH], held[1, i : i + BATCH]
                held = held[:, full:]
            if held.shape[1]:
                yield held[0], held[1]

        tokens = descend(mine, windows(), rate)
        if tokens:
            for i in range(0, len(mine.flat), 20_000):
                part = mine.flat[i : i + 20_000].astype(np.float64) * tokens
                columns = [pa.array(np.arange(i, i + len(part), dtype=np.int32)), pa.array(part), pa.array(np.full(len(part), tokens, np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["at", "weighted", "tokens"])

    return run


def _windows(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Inputs and targets (2, n, WINDOW) of all windows of texts: each token is a target once, after the tokens before it in its text."""
    inputs, own, _ = blocks(ids, starts)
    targets = np.full_like(inputs, PAD)
    targets[:, WINDOW - STEP :] = own
    return np.stack([inputs, targets])


def train(encoded: DataFrame, counts: DataFrame, n_docs: int, tokenizer: str) -> Model:
    """The model of all texts of ``encoded`` (``ids``, ``turn``): biases from all their subwords, the rest by rounds of local descent.

    In each round every task descends from the common weights over its documents of that round (a
    third of them by a hash of the id), on every window of each text, so that the rounds make one pass
    over all tokens; the weights are averaged by tokens in a grouped sum and begin the next round.
    """
    found = map_arrow(counts, _subword_counts(tokenizer), "id int, count bigint").groupBy("id").agg(F.sum("count").alias("count")).collect()
    held = np.zeros(VOCABULARY)
    for row in found:
        held[row["id"]] = row["count"]
    held[END] = n_docs
    model = initial(held)
    for k in range(ROUNDS):
        part = encoded.where(F.col("turn") == k).select("ids")
        sums = map_arrow(part, _training(tokenizer, model, 0.01 / (k + 1), k, "ids"), "at int, weighted double, tokens bigint").groupBy("at").agg((F.sum("weighted") / F.sum("tokens")).alias("weight"))
        new = sums.toArrow()
        if new.num_rows:
            model.flat[new.column("at").to_numpy()] = new.column("weight").to_numpy().astype(np.float32)
    return model


_TEXT = "key bigint, doc_id {kind}, held_out boolean, turn int, n_tokens bigint, head_known bigint, head_score double, rare array<string>, ids binary"


def _encoding(job: str, tokenizer: str, head: dict[bytes, float], end: tuple[int, float]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: a row per text with what its frequent words add up to, its rarer words, and its subwords, two bytes each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = _with_head(job, tokenizer, head)
        key = TaskContext.get().partitionId() << 33
        for part in slices(batches, "_body", 2 << 20):
            documents = [words_of(t) for t in texts(part.column("_body"))]
            n = len(documents)
            rows, bounds = subwords.rows(documents)
            ids, starts = subwords.subwords(rows, bounds)
            owner, word = np.repeat(np.arange(n), np.diff(bounds)), rows >= 0
            owner, rows = owner[word], rows[word]
            value = subwords.values[rows]
            rare = np.isnan(value)
            names = pa.array(map(subwords.words.__getitem__, rows[rare].tolist()), pa.binary()).cast(pa.string())
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[rare], minlength=n))])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key + np.arange(n)), part.column("doc_id"), part.column("held_out"), part.column("turn"),
                    pa.array(np.diff(bounds)), pa.array(np.bincount(owner[~rare], minlength=n) + end[0]),
                    pa.array(np.bincount(owner[~rare], value[~rare], n) + end[1]),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), names),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * starts).astype(np.int32)), pa.py_buffer(ids.astype(np.int16))]),
                ],
                ["key", "doc_id", "held_out", "turn", "n_tokens", "head_known", "head_score", "rare", "ids"],
            )
            key += n

    return run


_KEPT = ["key", "doc_id", "held_out", "n_tokens", "head_known", "head_score"]


def _scoring(tokenizer: str, model: Model) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: the rows of ``_encoding`` with the model's log10 probability of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for part in slices(batches, "ids"):
            yield pa.RecordBatch.from_arrays([*map(part.column, _KEPT), pa.array(scorer.score(*_streams(part, tokenizer)))], [*_KEPT, "score"])

    return run


def score_texts(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", held: int = 1) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, a row per input row.

    Rows whose crc32 of the id modulo 5 is ``held`` are scored but not learned from. ``base_score``
    is the smoothed unigram of whole words and an end (log10); ``score`` is the attention model's
    log10 probability of the text: its words, lower-cased and each after a blank, as subwords, and
    the end. Counts of frequent words (``HEAD_SHARE``) are on every executor, those of
    rarer words are joined by the word.

    Each text is encoded once, into a table that training and scoring read (two bytes a subword).

    Null and empty texts are an end alone. Null ids are trained on as the empty id; repeated rows
    come out repeated and count as often as they occur. A long text is cut into windows and scored
    whole. Without training rows every word is unknown and the model is uniform; an empty table
    gives an empty one. Other columns are ignored, whatever their names. The weights depend on how
    the rows are dealt to tasks, as each task descends on its own.
    """
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)).cast("int")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_body")).withColumn("held_out", fold("doc_id") == held).withColumn("turn", F.when(~F.col("held_out"), turn))
    learned = docs.where("not held_out")
    counts = checkpoint(word_counts(learned, "_body"))
    n_docs = learned.count()
    total, distinct = counts.agg(F.sum("count"), F.count("*")).first()
    n, v = (total or 0) + n_docs, distinct + bool(n_docs)
    base = n + 0.5 * (v + 1)
    top = counts.where(F.col("count") >= n / HEAD_SHARE).collect()
    head = {r["word"].encode(): float(np.log10((r["count"] + 0.5) / base)) for r in top}
    end = (int(n_docs > 0), float(np.log10((n_docs + 0.5) / base)))
    kind = dict(docs.dtypes)["doc_id"]
    encoded = checkpoint(map_arrow(docs, _encoding(uuid.uuid4().hex, tokenizer, head, end), _TEXT.format(kind=kind)))
    model = train(encoded, counts, n_docs, tokenizer)
    scored = map_arrow(encoded.select(*_KEPT, "ids"), _scoring(tokenizer, model), ", ".join(f"{c} {t}" for c, t in encoded.select(*_KEPT).dtypes) + ", score double")
    met = encoded.select("key", F.explode("rare").alias("word")).join(counts, "word", "left")
    tail = met.groupBy("key").agg(F.count("count").alias("tail_known"), F.sum(F.log10((F.coalesce("count", F.lit(0)) + 0.5) / F.lit(base))).alias("tail_score"))
    n_known, base_score = (F.col(f"head_{c}") + F.coalesce(f"tail_{c}", F.lit(0)) for c in ("known", "score"))
    return scored.join(tail, "key", "left").select(
        "doc_id", "held_out", "n_tokens", n_known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base_score.alias("base_score"), "score",
    )
