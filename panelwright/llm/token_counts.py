"""Token counts of whole texts by rank-synchronous merging of ragged batches of pre-tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import bpe
from panelwright.llm.runtime import map_arrow, slices, texts, with_text

#: Chunk counts that a Python worker remembers before it starts afresh.
REMEMBERED = 300_000


class Counter:
    """Counts tokens; keeps the counts of chunks it has seen, keyed with their leading blank."""

    def __init__(self, path: str):
        self.model = bpe.load(path)
        self.first: dict[str, int] = {}
        self.inner: dict[str, int] = {}

    def _learn(self, known: dict[str, int], new: set[str], blank: str) -> None:
        new = [*new]
        pretokens = [bpe.PATTERN.findall(blank + chunk) for chunk in new]
        distinct = [*{p for each in pretokens for p in each}]
        _, offsets = self.model.merge([p.encode() for p in distinct])
        count = dict(zip(distinct, np.diff(offsets).tolist(), strict=True))
        known.update(zip(new, (sum(map(count.__getitem__, each)) for each in pretokens), strict=True))

    def count(self, batch: list[str]) -> list[int]:
        cut = [[(bpe.chunks(part), 0) if not special else ([], 1) for part, special in bpe.parts(self.model, text)] for text in batch]
        if len(self.inner) > REMEMBERED:
            self.inner.clear()
        if len(self.first) > REMEMBERED:
            self.first.clear()
        heads, rest = set(), set()
        for text in cut:
            for pieces, _ in text:
                heads.update(pieces[:1])
                rest.update(pieces[1:])
        self._learn(self.first, heads - self.first.keys(), "")
        self._learn(self.inner, rest - self.inner.keys(), " ")
        inner = self.inner.__getitem__
        return [sum(special + (self.first[pieces[0]] + sum(map(inner, pieces[1:])) if pieces else 0) for pieces, special in text) for text in cut]


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def _counting(path: str, text: str, kept: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for part in slices(batches, text):
            counts = pa.array(counter.count(texts(part.column(text))), pa.int64())
            size = pc.fill_null(pc.binary_length(part.column(text)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), size, counts], [*kept, "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 512, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (its columns in ``keep``, all by default) with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    ``tokenizer`` is the path of a byte-level BPE file for the tokenizers library, the same on all
    executors. Counts equal that library's without added special tokens; a special token's string
    inside a text is that one token.

    Null counts as the empty text: no bytes, no tokens. Added names replace columns of those
    names; other columns pass through, rows are independent, an empty table gives an empty one. A
    long text is counted whole, its words merged in batches like any other's; only a single word of
    many megabytes makes one large array.
    """
    sent, kept, schema = with_text(docs.drop("n_bytes", "n_tokens", "over_limit"), text, keep)
    counted = map_arrow(sent, _counting(tokenizer, text, kept), f"{schema}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
