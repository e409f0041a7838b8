"""Quality scores from a generalised additive model with pairwise interactions, learned as lookup tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.runtime import map_arrow, slices, texts, with_text

#: Labelled rows that a model is fitted on at most (those whose ids have the smallest hashes).
TRAINING_ROWS = 20_000
#: Documents at or above this score are kept.
THRESHOLD = 0.3

FEATURES = (
    "log_words", "word_length", "longest_word", "symbols", "pipes", "exclamations", "stops", "upper", "digits", "other_bytes", "spaces",
    "entropy", "distinct_words", "top_word", "repeats_next", "seen_triples", "odd_words", "short_words", "capital_words", "log_lines",
    "words_a_line", "short_lines", "repeated_lines", "ended_lines", "addresses",
)
_SYMBOLS = np.frombuffer(b"#*$%&<>~^=+\\", np.uint8)
_STOPS = np.frombuffer(b".,;:?", np.uint8)


def features(text: str) -> list[float]:
    """A text's features, shares unless named otherwise; a text without words has zeros."""
    body = text.encode()
    words = body.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    held = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    visible = max(1, int(held[33:].sum()))
    share = held[held > 0] / len(body)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in (line.strip() for line in body.split(b"\n")) if x]
    line_words = [x.count(b" ") + 1 for x in lines]
    return [
        float(np.log1p(n)), visible / n, float(np.log1p(lengths.max())), held[_SYMBOLS].sum() / visible, held[124] / visible, held[33] / visible,
        held[_STOPS].sum() / visible, held[65:91].sum() / visible, held[48:58].sum() / visible, held[128:].sum() / visible, 1 - visible / len(body),
        float(-(share * np.log2(share)).sum()), len(counts) / n, max(counts.values()) / n, sum(a == b for a, b in pairwise(words)) / n,
        sum(c for c in triples.values() if c > 1) / n, sum(not w.strip(b".,;:!?'\"()-").isalpha() and w.isascii() for w in words) / n,
        float((lengths <= 3).mean()), sum(65 <= w[0] <= 90 for w in words) / n, float(np.log1p(len(lines))), float(np.log1p(n / len(lines))),
        sum(c < 4 for c in line_words) / len(lines), 1 - len(set(lines)) / len(lines), sum(x[-1:] in b".!?:" for x in lines) / len(lines),
        (body.count(b"://") + body.count(b"@")) / n,
    ]


def _best_cut(gradient: np.ndarray, weight: np.ndarray, ridge: float, least: float) -> tuple[int, float]:
    """Where a row of bins is best cut in two, and the gain; no cut leaves a side less weight than ``least``."""
    g, w = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
    gr, wr = gradient.sum() - g, weight.sum() - w
    gain = np.where((w >= least) & (wr >= least), g * g / (w + ridge) + gr * gr / (wr + ridge), -np.inf)
    if not len(gain) or not np.isfinite(gain.max()):
        return 0, -np.inf
    at = int(np.argmax(gain))
    return at + 1, float(gain[at] - gradient.sum() ** 2 / (weight.sum() + ridge))


def _shallow_tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = 3, ridge: float = 1.0, least: float = 2.0) -> np.ndarray:
    """A step per bin: the tree of up to ``leaves`` leaves that the best cuts give."""
    bounds = [0, len(gradient)]
    while len(bounds) <= leaves:
        cuts = [(_best_cut(gradient[a:b], weight[a:b], ridge, least), a) for a, b in pairwise(bounds)]
        (at, gain), start = max(cuts, key=lambda c: c[0][1])
        if gain <= 1e-9:
            break
        bounds = sorted([*bounds, start + at])
    step = np.empty(len(gradient))
    for a, b in pairwise(bounds):
        step[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + ridge)
    return step


def _quadrants(gradient: np.ndarray, weight: np.ndarray, ridge: float = 2.0, least: float = 2.0) -> tuple[np.ndarray, float]:
    """A step per cell of two features' bins: one cut on the rows, then one on each side's columns."""
    best, gain = None, 0.0
    whole = gradient.sum() ** 2 / (weight.sum() + ridge)
    for cut in range(1, len(gradient)):
        step, total = np.empty_like(gradient), -whole
        for side in (slice(0, cut), slice(cut, None)):
            g, w = gradient[side].sum(axis=0), weight[side].sum(axis=0)
            at, _ = _best_cut(g, w, ridge, least)
            for part in (slice(0, at), slice(at, None)) if at else (slice(None),):
                gs, ws = g[part].sum(), w[part].sum() + ridge
                step[side, part] = gs / ws
                total += gs * gs / ws
        if weight[:cut].sum() >= least <= weight[cut:].sum() and total > gain:
            best, gain = step, total
    return (np.zeros_like(gradient) if best is None else best), gain


@dataclass
class Gam:
    """``intercept`` plus a table for each feature's bins plus a table for each pair's coarse bins, in log odds."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    coarse: int = 8

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)], axis=1)

    def coarse_bins(self, bins: np.ndarray) -> np.ndarray:
        return np.stack([bins[:, f] * self.coarse // (len(c) + 1) for f, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        odds = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            odds += table[bins[:, f]]
        if self.pairs:
            rough = self.coarse_bins(bins)
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                odds += table[rough[:, a], rough[:, b]]
        return 1 / (1 + np.exp(-odds))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.08, bins: int = 32, n_pairs: int = 6) -> Gam:
    """Cyclic boosting: in each round every feature in turn adds a small tree fitted to what is left.

    Pairs are ranked by what one tree on them gains after the main tables and then boosted likewise.
    No rows give a model that scores 0.5; rows of one class one that is close to it.
    """
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(len(FEATURES))]
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(float(np.log(share / (1 - share))), cuts, [np.zeros(len(c) + 1) for c in cuts])
    if not 0 < y.sum() < len(y):
        return model
    at = model.bins(x)
    odds = np.full(len(x), model.intercept)
    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-odds))
            g, w = (np.bincount(at[:, f], v, minlength=len(table)) for v in (y - p, p * (1 - p)))
            step = rate * np.clip(_shallow_tree(g, w), -4, 4)
            table += step
            odds += step[at[:, f]]
    rough, k = model.coarse_bins(at), model.coarse

    def cells(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-odds))
        place = rough[:, a] * k + rough[:, b]
        return tuple(np.bincount(place, v, minlength=k * k).reshape(k, k) for v in (y - p, p * (1 - p)))

    model.pairs = sorted(combinations(range(len(FEATURES)), 2), key=lambda ab: -_quadrants(*cells(*ab))[1])[:n_pairs]
    model.pair_tables = [np.zeros((k, k)) for _ in model.pairs]
    for _ in range(rounds // 5):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            step = rate * np.clip(_quadrants(*cells(a, b))[0], -4, 4)
            table += step
            odds += step[rough[:, a], rough[:, b]]
    return model


def _featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "_body"):
        rows = [features(t) for t in texts(part.column("_body"))]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def fold(doc_id: str | Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as the empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit("")).cast("binary")) % folds).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, text: str, rows: int, label: str = "quality") -> DataFrame:
    """``(doc_id, label, _body)`` of up to ``rows`` labelled documents outside fold 0, those of the smallest id hashes.

    Ids whose label rows disagree or are null, labels other than 0 and 1, and labels without a
    document are left out and take no place; an id that repeats is one row, with the least of its texts.
    """
    clear = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("most"))
    clear = clear.where(F.col("label").isin(0, 1) & (F.col("label") == F.col("most")) & (fold("doc_id") != 0))
    held = clear.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = held.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", F.col("label").cast("int").alias("label"))
    found = docs.select("doc_id", F.col(text).alias("_body")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("_body").alias("_body"))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = TRAINING_ROWS) -> Gam:
    """The model of ``labels.quality`` over a bounded set of labelled rows; their features alone reach the driver."""
    kind = dict(docs.dtypes)["doc_id"]
    found = map_arrow(labelled(docs, labels, text, rows), _featured, f"doc_id {kind}, label int, x array<double>").toArrow()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    x = np.array(found.column("x").to_pylist(), float).reshape(len(order), len(FEATURES))[order]
    return fit(x, found.column("label").to_numpy().astype(float)[order])


def _scoring(model: Gam, text: str, kept: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            x = np.array([features(t) for t in texts(part.column(text))])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(model.score(x))], [*kept, "score"])

    return run


def score_quality(docs: DataFrame, model: Gam, text: str = "text", threshold: float = THRESHOLD, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (its columns in ``keep``, all by default) with ``score`` (0 to 1, how likely the label is 1) and ``predicted`` (1 from ``threshold`` on).

    Only the whole text enters the score. Null and empty texts have the score of a text without
    words. Columns named ``score`` or ``predicted`` are replaced, others pass through; rows are
    independent, so that repeated rows score alike; an empty table gives an empty one. Long texts
    are read whole, one after another.
    """
    sent, kept, schema = with_text(docs.drop("score", "predicted"), text, keep)
    scored = map_arrow(sent, _scoring(model, text, kept), f"{schema}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
