"""Quality rules: counted text statistics, and a calibrated logistic regression on hashed n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.quality_gam import labelled
from panelwright.llm.runtime import map_arrow, slices, texts, with_text

#: Labelled rows that the regression is fitted on at most, buckets of each of the three n-gram kinds, and the threshold.
TRAINING_ROWS, BUCKETS, THRESHOLD = 4_000, 2_048, 0.3
WINDOW = 5
_SYMBOLS = regex.compile(rb"[#*$%&|<>]")


def repeated_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    code = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + code[i : i + n]
    _, place, count = np.unique(mixed, return_inverse=True, return_counts=True)
    alike = np.flatnonzero(count[place] > 1)
    if not len(alike):
        return 0
    windows = [tuple(words[i : i + WINDOW]) for i in alike]  # windows of one hash are compared in full
    held = Counter(windows)
    change = np.zeros(len(words) + 1, np.int64)
    at = np.array([i for i, w in zip(alike, windows, strict=True) if held[w] > 1], np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def statistics(text: str) -> tuple[int, int, int, int, int]:
    """``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)``."""
    body = text.encode()
    words = body.split()
    whole = np.frombuffer(b"".join(words), np.uint8)
    lines = [line for line in body.split(b"\n") if line.strip()]
    return len(words), int(((whole & 0xC0) != 0x80).sum()), len(_SYMBOLS.findall(body)), len(lines) - len(set(lines)), repeated_words(words)


def _bucket(values: np.ndarray, salt: int) -> np.ndarray:
    mixed = (values + np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.int64) % BUCKETS


def hashed(text: str) -> np.ndarray:
    """Square roots of the shares of hashed words, word pairs and 4-byte character n-grams."""
    body = np.frombuffer(text.encode(), np.uint8)
    out = np.zeros(3 * BUCKETS, np.float32)
    solid = (body > 32) | ((body < 9) | ((body > 13) & (body < 32)))
    edge = np.diff(np.concatenate([[0], solid.astype(np.int8), [0]]))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return out
    wide = body.astype(np.uint64)
    within = np.zeros(len(body), np.int64)  # a byte's place in its word
    within[starts[0] :] = np.arange(starts[0], len(body)) - np.repeat(starts, np.diff(np.append(starts, len(body))))
    powers = np.uint64(0x100000001B3) ** within.astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((wide + np.uint64(1)) * powers * solid)])
    word = sums[stops] - sums[starts]
    kinds = [word, word[:-1] * np.uint64(31) + word[1:]]
    if len(wide) > 3:
        kinds.append(wide[:-3] | wide[1:-2] << np.uint64(8) | wide[2:-1] << np.uint64(16) | wide[3:] << np.uint64(24))
    for i, values in enumerate(kinds):
        if len(values):
            out[i * BUCKETS : (i + 1) * BUCKETS] = np.sqrt(np.bincount(_bucket(values, i), minlength=BUCKETS) / len(values))
    return out


@dataclass
class Regression:
    weights: np.ndarray
    bias: float
    slope: float = 1.0  # of the calibration
    shift: float = 0.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.odds(x) + self.shift)))


def _descend(x: np.ndarray, y: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression by Nesterov's accelerated gradient over all rows."""
    n, width = x.shape
    w, bias = np.zeros(width), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    rate = 4.0 / (np.mean(np.einsum("ij,ij->i", x, x)) + 1 + 4 * ridge)
    last_w, last_b = w, bias
    for k in range(1, steps + 1):
        ahead = (k - 1) / (k + 2)
        look_w, look_b = w + ahead * (w - last_w), bias + ahead * (bias - last_b)
        last_w, last_b = w, bias
        wrong = 1 / (1 + np.exp(-(x @ look_w.astype(x.dtype) + look_b))) - y
        w = look_w - rate * (x.T @ wrong.astype(x.dtype) / n + ridge * look_w)
        bias = look_b - rate * wrong.mean()
    return w, bias


def fit(x: np.ndarray, y: np.ndarray, calibration: np.ndarray, ridge: float = 1e-5, steps: int = 400) -> Regression:
    """Fitted on the rows outside ``calibration``, then scaled on those inside so that scores are probabilities.

    Without rows of both classes the model gives the share of label 1 (0.5 without rows).
    """
    inner = ~calibration
    if not 0 < y[inner].sum() < inner.sum():
        return Regression(np.zeros(x.shape[1]), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    model = Regression(*_descend(x[inner], y[inner], ridge, steps))
    if 0 < y[calibration].sum() < calibration.sum():
        odds = model.odds(x[calibration])
        center, spread = odds.mean(), odds.std() or 1.0
        scale, shift = _descend(((odds - center) / spread)[:, None], y[calibration], 0.01, 400)
        model.slope, model.shift = float(scale[0] / spread), float(shift - scale[0] * center / spread)
    return model


def _hashing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "_body"):
        rows = [hashed(t) for t in texts(part.column("_body"))]
        places = [np.flatnonzero(r).astype(np.int32) for r in rows]
        values = [r[p] for r, p in zip(rows, places, strict=True)]
        columns = [part.column("doc_id"), part.column("label"), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "place", "value"])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = TRAINING_ROWS) -> Regression:
    """The regression on ``labels.quality`` over a bounded set of labelled rows; a fifth of them calibrate it."""
    kind = dict(docs.dtypes)["doc_id"]
    chosen = labelled(docs, labels, text, rows).withColumn("aside", (F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(5)) == 0).cast("int"))
    chosen = chosen.withColumn("label", F.col("label") + 2 * F.col("aside")).drop("aside")
    found = map_arrow(chosen, _hashing, f"doc_id {kind}, label int, place array<int>, value array<float>").toArrow()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    marks = found.column("label").to_numpy()[order]
    x = np.zeros((len(order), 3 * BUCKETS), np.float32)
    place, value = found.column("place").combine_chunks(), found.column("value").combine_chunks()
    for i, k in enumerate(order):
        x[i, place[int(k)].values.to_numpy()] = value[int(k)].values.to_numpy()
    return fit(x, (marks % 2).astype(float), marks >= 2)


def _ruling(model: Regression, text: str, kept: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, 1 << 20):
            bodies = texts(part.column(text))
            counts = np.array([statistics(t) for t in bodies], np.int64)
            chance = np.concatenate([model.probability(np.stack([hashed(t) for t in bodies[i : i + 200]])) for i in range(0, len(bodies), 200)])
            columns = [*(part.column(c) for c in kept), *(pa.array(counts[:, i]) for i in range(5)), pa.array(chance.astype(float))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *COUNTS, "probability"])

    return run


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def apply_rules(docs: DataFrame, model: Regression, text: str = "text", threshold: float = THRESHOLD, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (its columns in ``keep``, all by default) with the five counts of ``COUNTS``, ``probability``, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 10 words, or over a fifth of the words in repeated 5-word windows.
    ``kept``: not so, and the model's probability of good quality is at least ``threshold``.

    Null and empty texts have zero counts and fail. Added names replace columns of those names,
    others pass through; rows are independent, so that repeated rows are judged alike; an empty
    table gives an empty one. Long texts are read whole, one after another.
    """
    sent, kept, schema = with_text(docs.drop(*COUNTS, "probability", "base_failed", "kept"), text, keep)
    ruled = map_arrow(sent, _ruling(model, text, kept), schema + "".join(f", {c} bigint" for c in COUNTS) + ", probability double")
    ruled = ruled.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return ruled.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold))
