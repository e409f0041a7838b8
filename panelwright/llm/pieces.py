"""SentencePiece BPE models: normalising with source alignment, encoding with byte spans, and decoding."""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import codec
from panelwright.llm.codec import ragged
from panelwright.llm.runtime import map_arrow, slices, texts, with_text

# Fixed values of the public model format: kinds of pieces, field numbers, the blank's stand-in.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
_PIECES, _TRAINER, _NORMALIZER, _DENORMALIZER = 1, 2, 3, 5
_CHARSMAP, _DUMMY, _REMOVE_EXTRA, _ESCAPE = 2, 3, 4, 5
_MODEL_TYPE, _BPE, _SUFFIX, _UNK_SURFACE, _BYTE_FALLBACK = 3, 2, 24, 44, 35
BLANK = "▁"

_NONE = np.iinfo(np.int32).max
#: Longer runs of mergeable characters are merged on a heap, each in n log n steps.
LONG = 64
#: Words that a Python worker remembers before it starts afresh.
REMEMBERED = 300_000


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(number, value)`` of a protocol buffer message, one level deep."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """The compiled character map: a double-array trie of UTF-8 keys, and the texts that replace them."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, np.uint32, size // 4, 4).tolist() if blob else []
        self.pool = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, str] | None:
        """The longest key that ``data`` has at ``at``: its bytes, and its replacement."""
        found = None
        if not self.units:
            return None
        node = self._offset(self.units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.pool[found[1] : self.pool.index(b"\0", found[1])].decode()


class Normalizer:
    """Replaces the longest prefixes that the character map knows, and treats blanks as the model says."""

    def __init__(self, spec: dict):
        self.map = CharacterMap(spec.get(_CHARSMAP, b""))
        self.dummy, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (_DUMMY, _REMOVE_EXTRA, _ESCAPE))
        self.plain = not self.map.units and self.dummy and not self.squeeze and self.escape

    def normalize(self, text: str) -> tuple[str, list[int]]:
        """The normalised text, and the byte of ``text`` at which each of its characters begins (one more for the end).

        All that replaces a prefix begins where the prefix does, so that a piece that ends within a
        replacement spans no source; a blank put in front begins where what follows does.
        """
        data, blank = text.encode(), BLANK if self.escape else " "
        out: list[str] = []
        begin: list[int] = []
        at, spaced = 0, self.squeeze
        if self.squeeze:
            while at < len(data) and (unit := self._unit(data, at))[1] == " ":
                at += unit[0]
        if at == len(data):
            return "", [at]
        if self.dummy:
            out.append(blank)
            begin.append(at)
        while at < len(data):
            size, new = self._unit(data, at)
            if spaced:
                new = new.lstrip(" ")
            for c in new:
                out.append(blank if c == " " else c)
                begin.append(at)
            if new:
                spaced = new.endswith(" ")
            at += size
            spaced = spaced and self.squeeze
        end = at
        if self.squeeze:
            while out and out[-1] == blank:
                out.pop()
                end = begin.pop()
        return "".join(out), [*begin, end]

    def _unit(self, data: bytes, at: int) -> tuple[int, str]:
        found = self.map.longest(data, at)
        if found:
            return found
        size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        return size, data[at : at + size].decode()


class PieceModel:
    """A BPE model with byte fallback, as its file has it.

    Symbols are the pieces' ids and, above them, characters that only occur inside pieces. Any two
    symbols whose texts make a piece can merge, however the piece was trained, so that a merge may
    bring about a better one: each run of characters takes one merge a round, the leftmost of its
    best, and all runs of a batch take theirs at once.
    """

    def __init__(self, path: str):
        parts: dict[int, list[bytes]] = {}
        for number, value in fields(Path(path).read_bytes()):
            parts.setdefault(number, []).append(value)
        trainer, spec, back = (dict(fields(b"".join(parts.get(k, [])))) for k in (_TRAINER, _NORMALIZER, _DENORMALIZER))
        rows = [dict(fields(p)) for p in parts[_PIECES]]
        self.pieces = [r.get(1, b"").decode() for r in rows]
        scores = [struct.unpack("<f", r[2])[0] if 2 in r else 0.0 for r in rows]
        self.kinds = np.array([r.get(3, NORMAL) for r in rows])
        if trainer.get(_MODEL_TYPE) != _BPE or not trainer.get(_BYTE_FALLBACK) or trainer.get(_SUFFIX) or back.get(_CHARSMAP) or not {*self.kinds.tolist()} <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback, blanks in front and no pieces of the user's or unused ones can be read")
        self.normalizer = Normalizer(spec)
        self.size = len(rows)
        self.byte_ids = np.zeros(256, np.int64)
        self.byte_value = np.full(self.size, -1)
        for i in np.flatnonzero(self.kinds == BYTE).tolist():
            value = int(self.pieces[i][1:-1], 16)
            self.byte_ids[value], self.byte_value[i] = i, value
        surface = trainer.get(_UNK_SURFACE, b" \xe2\x81\x87 ")
        self.bytes = [
            b"" if k == CONTROL else surface if k == UNKNOWN else bytes([v]) if k == BYTE else p.replace(BLANK, " ").encode()
            for p, k, v in zip(self.pieces, self.kinds.tolist(), self.byte_value.tolist(), strict=True)
        ]
        normal = np.flatnonzero(self.kinds == NORMAL).tolist()
        self.symbol = {self.pieces[i]: i for i in normal}
        inner = sorted({c for p in self.symbol if len(p) > 1 for c in p})
        self.outputs: list[list[int]] = [[i] for i in range(self.size)]
        for c in inner:
            if c not in self.symbol:
                self.symbol[c] = len(self.outputs)
                self.outputs.append(self.byte_ids[[*c.encode()]].tolist())
        self.out_ids, self.out_at = np.array([*chain.from_iterable(self.outputs)], np.int64), np.concatenate([[0], np.cumsum([*map(len, self.outputs)])])
        place = {s: k for k, s in enumerate(sorted({-scores[i] for i in normal}))}
        pairs = [(self.symbol[p[:k]] * len(self.outputs) + self.symbol[p[k:]], place[-scores[i]], i) for p, i in self.symbol.items() if i < self.size for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol]
        keys, ranks, made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks, self.made = keys[order], ranks[order].astype(np.int32), made[order]
        points = {ord(p): i for p, i in self.symbol.items() if len(p) == 1}
        self.by_point = np.arange(max(points) + 1) + len(self.outputs)
        self.by_point[[*points]] = [*points.values()]
        # A blank never follows another character within a piece, so that words begin at blanks.
        self.by_words = self.normalizer.plain and not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.symbol)
        letters = "".join(map(re.escape, (c for c in inner if c != BLANK)))
        self.runs = re.compile(f"{BLANK}*[{letters}]+|{BLANK}+|." if self.by_words else f"[{BLANK}{letters}]+|.", re.DOTALL)
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)

    def _symbols(self, text: str) -> np.ndarray:
        """Each character's symbol; one that the model lacks has its code point behind all others and never merges."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        return np.where(points < len(self.by_point), self.by_point[np.minimum(points, len(self.by_point) - 1)], points + len(self.outputs))

    def _ids(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids that the symbols stand for, and their offsets."""
        rows, out_ids, out_at = symbols, self.out_ids, self.out_at
        lacking = symbols >= len(self.outputs)
        if lacking.any():
            points, place = np.unique(symbols[lacking] - len(self.outputs), return_inverse=True)
            more = [self.byte_ids[[*chr(p).encode()]] for p in points.tolist()]
            rows = symbols.copy()
            rows[lacking] = len(self.outputs) + place
            out_ids, out_at = np.concatenate([out_ids, *more]), np.concatenate([out_at, out_at[-1] + np.cumsum([len(m) for m in more])])
        ids, starts = ragged(out_ids, out_at, rows)
        return ids, starts[at]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each pair's rank (none: the largest number) and the place of what it makes."""
        keys = left * len(self.outputs) + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE), at

    def merge(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all runs one after another, and offsets."""
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        ids = self._symbols("".join(runs))
        owner = np.repeat(np.arange(len(runs)), lengths)
        rank, made = np.full(len(ids), _NONE, np.int32), np.zeros(len(ids), np.int64)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner], made[inner] = self._pairs(ids[inner], ids[inner + 1])
        done_ids, done_owner = [], []
        while len(ids):
            first = np.concatenate([[True], owner[1:] != owner[:-1]])
            starts = np.flatnonzero(first)
            low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
            over = low == _NONE
            if over.any():
                done_ids.append(ids[over])
                done_owner.append(owner[over])
                live = ~over
                ids, owner, rank, made, low = ids[live], owner[live], rank[live], made[live], low[live]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == low)
            at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])]  # the leftmost of each run
            ids[at] = self.made[made[at]]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, owner, rank, made = ids[stay], owner[stay], rank[stay], made[stay]
            at = at - np.arange(len(at))
            near = np.zeros(len(ids), bool)
            near[at] = near[at[at > 0] - 1] = True
            touched = np.flatnonzero(near)
            follow = np.where(touched + 1 >= len(ids), 0, touched + 1)
            pair = (touched + 1 < len(ids)) & (owner[touched] == owner[follow])
            ranks, place = self._pairs(ids[touched], ids[follow])
            rank[touched], made[touched] = np.where(pair, ranks, _NONE), place
        if done_ids:
            ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
            order = np.argsort(owner, kind="stable")
            ids, owner = ids[order], owner[order]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(runs)))])

    def merge_long(self, run: str) -> list[int]:
        """The symbols of one run, its pairs on a heap by rank and place."""
        ids = self._symbols(run).tolist()
        before, after = [*range(-1, len(ids) - 1)], [*range(1, len(ids) + 1)]
        ranks, places = self._pairs(np.array(ids[:-1]), np.array(ids[1:])) if len(ids) > 1 else ([], [])
        heap = [(int(r), k, ids[k], ids[k + 1], int(self.made[p])) for k, (r, p) in enumerate(zip(ranks, places, strict=True)) if r != _NONE]
        heapq.heapify(heap)

        def push(left: int) -> None:
            right = after[left]
            if left >= 0 and right < len(ids):
                (rank,), (place,) = self._pairs(np.array([ids[left]]), np.array([ids[right]]))
                if rank != _NONE:
                    heapq.heappush(heap, (int(rank), left, ids[left], ids[right], int(self.made[place])))

        while heap:
            _, left, a, b, made = heapq.heappop(heap)
            right = after[left]
            if ids[left] != a or right >= len(ids) or ids[right] != b:
                continue  # one of them has merged since
            ids[left], ids[right] = made, -1
            after[left] = after[right]
            if after[left] < len(ids):
                before[after[left]] = left
            push(left)
            if before[left] >= 0:
                push(before[left])
        return [i for i in ids if i >= 0]

    def encode_normal(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each normalised text, and offsets; characters that the model lacks become their bytes."""
        cut = [self.runs.findall(t) for t in batch]
        place = {r: i for i, r in enumerate(dict.fromkeys(chain.from_iterable(cut)))}
        runs = [*place]
        long = [i for i, r in enumerate(runs) if len(r) > LONG]
        merged = [self.merge_long(runs[i]) for i in long]
        for i in long:
            runs[i] = ""
        table, at = self.merge(runs)
        # The long runs' symbols stand behind all others.
        rows = np.arange(len(runs))
        rows[long] = len(runs) + np.arange(len(long))
        at = np.concatenate([at, at[-1] + np.cumsum([*map(len, merged)], dtype=np.int64)])
        table, at = self._ids(np.concatenate([table, np.array([*chain.from_iterable(merged)], np.int64)]), at)
        ids, at = ragged(table, at, rows[np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), np.int64)])
        return ids, at[np.concatenate([[0], np.cumsum([*map(len, cut)], dtype=np.int64)])]


class Encoder:
    """Encodes texts; where words begin at blanks it keeps the ids of words that it has seen."""

    def __init__(self, path: str):
        self.model = load(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and offsets."""
        if not self.model.by_words:
            return self.model.encode_normal([self.model.normalizer.normalize(t)[0] for t in batch])
        cut: list[list[str]] = []
        for text in batch:
            text = text.replace(BLANK, " ") if BLANK in text else text
            words = text.split(" ") if text else []
            if "" in words:  # several blanks in a row, or at an end; each word keeps those in front of it but one
                words = [w[1:] for w in re.findall(" +[^ ]*", f" {text}")]
            cut.append(words)
        if len(self.known) > REMEMBERED:
            self._forget()
        new = [*{*chain.from_iterable(cut)}.difference(self.known)]
        ids, at = self.model.encode_normal([f"{BLANK}{w.replace(' ', BLANK)}" for w in new])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.ids, self.at = np.concatenate([self.ids, ids]), np.concatenate([self.at, self.at[-1] + at[1:]])
        flat = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64)
        ids, at = ragged(self.ids, self.at, flat)
        return ids, at[np.concatenate([[0], np.cumsum([len(c) for c in cut], dtype=np.int64)])]

    def _begins(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The source byte at which each normalised character of each text begins and, last, its end; offsets."""
        if not self.model.by_words:
            begins = [self.model.normalizer.normalize(t)[1] for t in batch]
            return np.array([*chain.from_iterable(begins)], np.int64), np.concatenate([[0], np.cumsum([*map(len, begins)])])
        points = np.frombuffer("".join(batch).encode("utf-32-le"), np.uint32)
        ends = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
        counts = np.fromiter(map(len, batch), np.int64, len(batch))
        last = np.cumsum(counts)
        # The blank put in front begins at 0 as the first character does; an empty text has but its end.
        rows = 1 + counts + (counts > 0)
        at = np.concatenate([[0], np.cumsum(rows)])
        within = np.arange(at[-1]) - np.repeat(at[:-1], rows)
        first = np.repeat(last - counts, rows)
        return ends[first + np.maximum(within - 1, 0)] - ends[first], at

    def spans(self, batch: list[str], ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each id's source begins and ends, in UTF-8 bytes; of a character's byte pieces the last has it, the others nothing."""
        model = self.model
        value = model.byte_value[ids]
        next_value = np.append(value[1:], -1)
        size = np.where(value >= 0, ~((next_value >= 0x80) & (next_value < 0xC0)), model.lengths[ids])
        done = np.concatenate([[0], np.cumsum(size)])
        begins, begin_at = self._begins(batch)
        counts = np.diff(at)
        shift = np.repeat(begin_at[:-1] - done[at[:-1]], counts)
        return begins[done[:-1] + shift], begins[done[1:] + shift]


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def _piece_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    pieces = load(path).bytes
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])


def _text(data: bytes) -> str:
    """UTF-8 with one replacement character for each byte that isn't part of a character."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            try:
                out.append(data[at:].decode())
                break
            except UnicodeDecodeError as e:
                out.append(data[at : at + e.start].decode() + "�")
                at += e.start + 1
        return "".join(out)


def decode_ids(path: str, ids: np.ndarray, at: np.ndarray) -> list[str]:
    """The text of each ``ids[at[i]:at[i + 1]]``: control pieces are nothing, the blank in front is left out."""
    model = load(path)
    flat, ends = ragged(*_piece_bytes(path), ids.astype(np.int64))
    whole, bounds = flat.tobytes(), ends[at].tolist()
    seen = np.flatnonzero(model.kinds[ids] != CONTROL) if len(ids) else ids
    head = np.searchsorted(seen, at[:-1]) if len(seen) else np.zeros(len(at) - 1, np.int64)
    cut = []
    for k, last in zip(head.tolist(), at[1:].tolist(), strict=True):
        first = int(seen[k]) if k < len(seen) else last
        cut.append(first < last and model.normalizer.dummy and model.kinds[ids[first]] == NORMAL and model.pieces[int(ids[first])].startswith(BLANK))
    return [_text(whole[a + c : b]) for a, b, c in zip(bounds, bounds[1:], cut, strict=False)]


def _encoding(path: str, text: str, kept: list[str], back: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for part in slices(batches, text, 1 << 20):
            batch = texts(part.column(text))
            ids, at = encoder.encode(batch)
            begin, end = encoder.spans(batch, ids, at)
            offsets = pa.array(at.astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (ids, begin, end)]
            columns, names = [*(part.column(c) for c in kept), *lists], [*kept, "ids", "begins", "ends"]
            if back:
                columns, names = [*columns, pa.array(decode_ids(path, ids, at), pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, model: str, text: str = "text", keep: Sequence[str] | None = None, back: bool = False) -> DataFrame:
    """``docs`` (its columns in ``keep``, all by default) with ``ids`` of the whole text as the sentencepiece library gives them, and their spans.

    ``ids[i]`` stands for the bytes ``begins[i]`` to ``ends[i]`` of the text in UTF-8; of the bytes
    that stand for one character the last has its span. ``back`` adds ``decoded``, the text that
    the ids decode to. ``model`` is the path of a BPE model with byte fallback, the same on all
    executors; no begin or end ids are added.

    Null encodes as the empty text, to no ids. Columns of the added names are replaced; others pass
    through. Rows are independent and repeat as they do; an empty table gives an empty one. A long
    text is encoded whole and alone, in memory in proportion to it.
    """
    sent, kept, schema = with_text(docs.drop("ids", "begins", "ends", *["decoded"] * back), text, keep)
    added = ", ids array<int>, begins array<int>, ends array<int>" + ", decoded string" * back
    return map_arrow(sent, _encoding(model, text, kept, back), schema + added)


def _decoding(path: str, kept: list[str], ids: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids)
            rows = lists.flatten().to_numpy(zero_copy_only=False)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            decoded = decode_ids(path, rows.astype(np.int64), np.concatenate([[0], np.cumsum(counts)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(decoded, pa.string())], [*kept, "decoded"])

    return run


def decode(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, as the sentencepiece library decodes their ids; null ids decode as the empty text."""
    rows = rows.drop("decoded")
    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes) + ", decoded string"
    return map_arrow(rows, _decoding(model, rows.columns, ids), schema)


def digests(rows: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, n_spanned)`` of encoded rows; ``n_spanned``: the bytes of the text that the pieces' spans cover.

    The spans follow one another, so that they cover what lies before the last one's end.
    """
    spanned = F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_spanned")
    return codec.digests(rows.withColumn("doc_id", F.struct("doc_id", spanned))).select("doc_id.doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "doc_id.n_spanned")
