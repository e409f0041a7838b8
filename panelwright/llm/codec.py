"""BPE encoding and decoding of whole texts through a memory-mapped lexicon of the corpus's frequent words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import bpe
from panelwright.llm.lexicon import Lexicon, compile_lexicon
from panelwright.llm.runtime import map_arrow, shared_dir, slices, texts, with_text

#: A word is frequent if it makes up one in so many bytes of the corpus, its blank not counted. Each
#: occurrence takes two bytes with its blank, so at most half as many words are, whatever the corpus.
FREQUENT, LEXICON_BYTES = 1 << 19, 32


def ragged(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values[offsets[r]:offsets[r + 1]]`` of all ``rows`` one after another, and where each begins (and the end)."""
    lengths = np.diff(offsets)[rows]
    stops = np.cumsum(lengths)
    at = np.arange(stops[-1] if len(stops) else 0) + np.repeat(offsets[:-1][rows] - stops + lengths, lengths)
    return values[at], np.concatenate([[0], stops])


def encode_words(model: bpe.ByteBPE, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each word by exact merging of its pre-tokens, and offsets."""
    pretokens = [[word] if word[1:].isalpha() and word[0] == " " and word.isascii() else bpe.PATTERN.findall(word) for word in words]  # a blank and letters are one
    place = {p: i for i, p in enumerate(dict.fromkeys(chain.from_iterable(pretokens)))}
    ids, offsets = model.merge([p.encode() for p in place])
    flat = np.fromiter(map(place.__getitem__, chain.from_iterable(pretokens)), np.int64)
    ids, starts = ragged(ids, offsets, flat)
    return ids, starts[np.concatenate([[0], np.cumsum([len(p) for p in pretokens], dtype=np.int64)])]


class Encoder:
    def __init__(self, tokenizer: str, lexicon: Lexicon):
        self.model, self.lexicon = bpe.load(tokenizer), lexicon

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, from the lexicon or, for those that it doesn't have, by merging."""
        number = self.lexicon.find([w.encode() for w in words])
        unseen = np.flatnonzero(number < 0)
        merged, merged_at = encode_words(self.model, [words[i] for i in unseen])
        ids = np.concatenate([self.lexicon.ids, merged])
        starts = np.concatenate([self.lexicon.offsets, len(self.lexicon.ids) + merged_at[1:]])
        rows = number
        rows[unseen] = len(self.lexicon.offsets) - 1 + np.arange(len(unseen))
        return ragged(ids, starts, rows)

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and offsets."""
        cut: list[list[str]] = []
        for text in batch:
            each: list[str] = []
            for part, special in bpe.parts(self.model, text):
                if special:
                    each.append(f"\0{part}")  # no cut begins with \0 and ends as a special token does: parts() takes those out
                else:
                    pieces = bpe.chunks(part)
                    each.append(pieces[0])
                    each.extend([" " + p for p in pieces[1:]])
            cut.append(each)
        place = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(cut)))}
        specials = {w: self.model.special[w[1:]] for w in place if w[:1] == "\0" and w[1:] in self.model.special}
        ids, starts = self.words(["" if w in specials else w for w in place])
        if specials:
            ids = np.concatenate([ids, np.array([*specials.values()], np.int64)])
            ids, starts = self._with_specials(ids, starts, [place[w] for w in specials])
        flat = np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), np.int64)
        ids, starts = ragged(ids, starts, flat)
        return ids, starts[np.concatenate([[0], np.cumsum([len(c) for c in cut], dtype=np.int64)])]

    @staticmethod
    def _with_specials(ids: np.ndarray, starts: np.ndarray, rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The special words' single ids, which stand at the end of ``ids``, put in their places."""
        lengths = np.diff(starts)
        lengths[rows] = 1
        moved = np.concatenate([[0], np.cumsum(lengths)])
        out = np.empty(moved[-1], ids.dtype)
        mask = np.zeros(moved[-1], bool)
        mask[moved[rows]] = True
        out[~mask], out[moved[rows]] = ids[: starts[-1]], ids[starts[-1] :]
        return out, moved


@lru_cache(maxsize=2)
def _encoder(tokenizer: str, lexicon: str) -> Encoder:
    return Encoder(tokenizer, Lexicon(SparkFiles.get(lexicon)))


def _encoding(tokenizer: str, lexicon: str, text: str, kept: list[str], back: bool = False) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, lexicon)
        for part in slices(batches, text, 1 << 20):
            ids, starts = encoder.encode(texts(part.column(text)))
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32)))
            columns, names = [*(part.column(c) for c in kept), lists], [*kept, "ids"]
            if back:
                columns, names = [*columns, pa.array(decode_ids(tokenizer, ids, starts), pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def frequent_words(docs: DataFrame, text: str = "text", frequent: int = FREQUENT) -> list[str]:
    """The blank-separated words that occur at least twice and once in ``bytes / frequent``, counted over all rows."""
    held = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    words = docs.select(F.explode(F.split(F.col(text), " ", -1)).alias("word")).where(F.octet_length("word").between(1, LEXICON_BYTES - 1))
    return [" " + r[0] for r in words.groupBy("word").count().where(F.col("count") >= max(2, held / frequent)).select("word").collect()]


def ship_lexicon(docs: DataFrame, tokenizer: str, text: str = "text") -> str:
    """Compiles the frequent words of ``docs`` and gives the name under which executors find the file."""
    words = frequent_words(docs, text)
    ids, starts = encode_words(bpe.load(tokenizer), words)
    store, top = fs.FileSystem.from_uri(shared_dir(docs.sparkSession))
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    with store.open_output_stream(f"{top}/{name}") as out:
        out.write(compile_lexicon({w.encode(): ids[a:b].tolist() for w, a, b in zip(words, starts, starts[1:], strict=False)}))
    docs.sparkSession.sparkContext.addFile(f"{shared_dir(docs.sparkSession).rstrip('/')}/{name}")
    return name


def encode(docs: DataFrame, tokenizer: str, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (its columns in ``keep``, all by default) with ``ids``: the tokens of the whole text as the tokenizers library gives them, without added ones.

    Frequent words (by their share, counted over all of ``docs``) come from a minimal acyclic
    transducer that each executor maps into memory; all other words are merged exactly, so the
    lexicon's make-up never changes a result.

    Null encodes as the empty text, to no ids. A column named ``ids`` is replaced; others pass
    through. Rows are independent; an empty table gives an empty one. A long text is encoded whole
    and alone, in memory in proportion to it.
    """
    sent, kept, schema = with_text(docs.drop("ids"), text, keep)
    return map_arrow(sent, _encoding(tokenizer, ship_lexicon(sent, tokenizer, text), text, kept), f"{schema}, ids array<int>")


@lru_cache(maxsize=2)
def _token_table(tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    tokens = bpe.load(tokenizer).token_bytes
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])


def decode_ids(tokenizer: str, ids: np.ndarray, starts: np.ndarray) -> list[str]:
    """The text of each ``ids[starts[i]:starts[i + 1]]``: its tokens' bytes, what isn't UTF-8 replaced."""
    flat, at = ragged(*_token_table(tokenizer), ids.astype(np.int64))
    whole, ends = flat.tobytes(), at[starts].tolist()
    return [whole[a:b].decode(errors="replace") for a, b in zip(ends, ends[1:], strict=False)]


def _decoding(tokenizer: str, kept: list[str], ids: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                lists = part.column(ids)
                rows = lists.flatten().to_numpy(zero_copy_only=False)
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                decoded = decode_ids(tokenizer, rows, np.concatenate([[0], np.cumsum(counts)]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(decoded, pa.string())], [*kept, "decoded"])

    return run


def decode(rows: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``: the text of their ids, special tokens included; null ids decode as the empty text."""
    rows = rows.drop("decoded")
    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes) + ", decoded string"
    return map_arrow(rows, _decoding(tokenizer, rows.columns, ids), schema)


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (its columns in ``keep``, all by default) with ``ids`` and the text ``decoded`` from them, in one pass.

    Nulls, empty and long texts, repeats, empty tables and clashing names are as in ``encode``.
    """
    sent, kept, schema = with_text(docs.drop("ids", "decoded"), text, keep)
    lexicon = ship_lexicon(sent, tokenizer, text)
    return map_arrow(sent, _encoding(tokenizer, lexicon, text, kept, True), f"{schema}, ids array<int>, decoded string")


def digests(rows: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of rows that have ``ids`` and ``decoded``."""
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
