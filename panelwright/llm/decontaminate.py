"""Benchmark decontamination: one Aho-Corasick automaton over normalised word windows, offsets mapped back."""

from __future__ import annotations

import math
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.runtime import map_arrow, new_folder, slices, texts, with_text

WINDOW, HIT_SHARE = 13, 20

# One byte stays one byte, so that a place in the normalised text is a place in the original:
# A-Z become a-z; digits, a-z and all bytes of non-ASCII characters stay; others separate words.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_NORMAL).split()


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of true marks begins and ends."""
    edge = np.diff(np.concatenate([[0], marks.view(np.int8), [0]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each count, one after another."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


class Automaton:
    """An Aho-Corasick automaton over word numbers, as arrays that a file can be mapped to.

    Nodes are numbered level by level, within a level by parent and word, from 1 on; 0 is the root.
    So the goto table is one sorted column of ``parent << 32 | word``, in which node ``n`` stands at
    ``n - 1``. ``fail`` is a node's longest proper suffix; ``report`` the node itself if a window
    ends there, else its longest suffix at which one does, else 0. A node takes 16 bytes.
    """

    ARRAYS = ("keys", "fail", "report", "first", "levels", "ends", "owners_at", "owners")

    def __init__(self, words: pa.Array, names: list[str], **arrays: np.ndarray):
        self.words, self.names = words, names
        for name in self.ARRAYS:
            setattr(self, name, arrays[name])

    def step(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The next state of each of many texts; a word of -1 is in no window."""
        after = self.first[words].astype(np.int64)
        live = np.flatnonzero((states > 0) & (words >= 0))
        held = states[live]
        while live.size:
            key = held << 32 | words[live]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            after[live[hit]] = at[hit] + 1
            live, held = live[~hit], self.fail[held[~hit]].astype(np.int64)
            live, held = live[held > 0], held[held > 0]
        return after

    def matches(self, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(places, nodes)``: each place of a sequence of word numbers at which a window ends, with its node.

        The sequence is cut into equal parts that advance together, a word of each at a time. A
        state depends on the last 13 words alone, so each part starts 12 words early to be exact.
        """
        early, size = WINDOW - 1, max(WINDOW, math.isqrt(len(sequence)))
        parts = -(-len(sequence) // size)
        padded = np.full(early + parts * size, -1, np.int64)
        padded[early : early + len(sequence)] = sequence
        lanes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, early + size)[::size].T)
        states = np.zeros(parts, np.int64)
        places, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for j, words in enumerate(lanes):
            states = self.step(states, words)
            if j >= early:
                node = self.report[states].astype(np.int64)
                live = np.flatnonzero(node)
                place, node = live * size + (j - early), node[live]
                while len(node):  # a window, then each shorter one that ends with it
                    places.append(place)
                    nodes.append(node)
                    node = self.report[self.fail[node]].astype(np.int64)
                    place, node = place[node > 0], node[node > 0]
        return np.concatenate(places), np.concatenate(nodes)

    def scan(self, bodies: Sequence[str]) -> Found:
        """What the windows hit in each of several texts, which are read once, together."""
        joined = b"".join(t.encode() + b" " for t in bodies)
        normal = np.frombuffer(joined.translate(_NORMAL), np.uint8)
        inside = normal != 32
        begin, end = _runs(inside)
        breaks = np.concatenate([[0], np.cumsum([len(t.encode()) + 1 for t in bodies])]).astype(np.int64)
        first = np.searchsorted(begin, breaks)
        found = Found(joined, breaks, begin, end, first, np.zeros(len(begin), bool), [[] for _ in bodies])
        if not len(self.keys) or not len(begin):
            return found
        letters = pa.py_buffer(np.ascontiguousarray(normal[inside]))
        words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)), letters])
        numbers = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        place = np.arange(len(begin)) + np.repeat(np.arange(len(bodies)), np.diff(first))  # one break after each text
        sequence = np.full(len(begin) + len(bodies), -1, np.int64)
        sequence[place] = numbers
        places, nodes = self.matches(sequence)
        if not len(places):
            return found
        last = np.searchsorted(place, places)
        change = np.zeros(len(begin) + 1, np.int64)
        np.add.at(change, last + 1 - np.searchsorted(self.levels, nodes, "right"), 1)
        np.add.at(change, last + 1, -1)
        found.hit = np.cumsum(change[:-1]) > 0
        pairs = np.unique((places - last) << 32 | np.searchsorted(self.ends, nodes))  # a text's number is the number of breaks before
        text, end_of = pairs >> 32, pairs & 0xFFFFFFFF
        many = self.owners_at[end_of + 1] - self.owners_at[end_of]
        owner = self.owners[np.repeat(self.owners_at[end_of], many) + _spread(many)]
        for pair in np.unique(np.repeat(text, many) << 32 | owner).tolist():
            found.items[pair >> 32].append(self.names[pair & 0xFFFFFFFF])
        return found

    def write(self, out) -> None:
        """The automaton as an Arrow file of one row."""
        columns = {"words": self.words, "names": pa.array(self.names, pa.large_string()), **{n: pa.array(getattr(self, n)) for n in self.ARRAYS}}
        table = pa.table({n: pa.LargeListArray.from_arrays(pa.array([0, len(a)], pa.int64()), a) for n, a in columns.items()})
        with pa.ipc.new_file(out, table.schema) as file:
            file.write_table(table)

    @classmethod
    def open(cls, path: str) -> Automaton:
        """The automaton of a file, whose arrays stay there: all workers of a machine share its pages."""
        table = pa.ipc.open_file(pa.memory_map(path)).read_all()
        held = {n: table.column(n).chunk(0).values for n in table.column_names}
        return cls(held["words"], held["names"].to_pylist(), **{n: held[n].to_numpy() for n in cls.ARRAYS})


class Found:
    """What a scan found: ``hit`` marks words, of which text ``i`` has those from ``first[i]`` to ``first[i + 1]``; ``items`` names each text's items."""

    def __init__(self, joined: bytes, breaks: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, hit: np.ndarray, items: list[list[str]]):
        self.joined, self.breaks, self.begin, self.end, self.first, self.hit, self.items = joined, breaks, begin, end, first, hit, items

    def spans(self, i: int) -> list[tuple[int, int]]:
        """Character ranges of text ``i``, as it was given, that the runs of hit words cover."""
        a, b = self.first[i], self.first[i + 1]
        starts, stops = _runs(self.hit[a:b])
        if not len(starts):
            return []
        top = self.breaks[i]
        original = np.frombuffer(self.joined, np.uint8)[top : self.breaks[i + 1]]
        chars = np.concatenate([[0], np.cumsum((original & 0xC0) != 0x80, dtype=np.int32)])
        return [*zip(chars[self.begin[a + starts] - top].tolist(), chars[self.end[a + stops - 1] - top].tolist(), strict=True)]


def build_automaton(items: Iterable[tuple[object, str | None]]) -> Automaton:
    """The automaton over all items' windows: runs of 13 words; a shorter item is one window, one without words has none."""
    vocabulary: dict[bytes, int] = {}
    names: dict[str, int] = {}
    text, lengths, item_of = array("i"), array("q"), array("q")
    for item, body in items:
        words = words_of(body or "")
        if words:
            text.extend(vocabulary.setdefault(w, len(vocabulary)) for w in words)
            lengths.append(len(words))
            item_of.append(names.setdefault(str(item), len(names)))
    length = np.array(lengths, np.int64)
    many = np.maximum(1, length - WINDOW + 1) * (length > 0)
    start = np.repeat(np.cumsum(length) - length, many) + _spread(many)
    size, owner = np.repeat(np.minimum(length, WINDOW), many), np.repeat(np.array(item_of, np.int64), many)

    flat, node, levels, keys = np.array(text, np.int64), np.zeros(len(start), np.int64), [1], []
    for depth in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > depth)
        level, at = np.unique(node[live] << 32 | flat[start[live] + depth], return_inverse=True)
        node[live] = levels[-1] + at
        keys.append(level)
        levels.append(levels[-1] + len(level))
    pairs = np.unique(node << 32 | owner)
    ends, owners_at = np.unique(pairs >> 32, return_index=True)
    first = np.zeros(len(vocabulary) + 1, np.int32)  # the last one is for the word -1
    if keys:
        first[keys[0]] = np.arange(1, levels[1])
    machine = Automaton(
        pa.array(list(vocabulary), pa.large_binary()), list(names), keys=np.concatenate([np.zeros(0, np.int64), *keys]), fail=np.zeros(levels[-1], np.int32), report=np.zeros(levels[-1], np.int32),
        first=first, levels=np.array(levels[:-1], np.int64), ends=ends, owners_at=np.append(owners_at, len(pairs)).astype(np.int64), owners=pairs & 0xFFFFFFFF,
    )
    machine.report[ends] = ends
    for a, b in zip(levels, levels[1:], strict=False):
        above, word = machine.keys[a - 1 : b - 1] >> 32, machine.keys[a - 1 : b - 1] & 0xFFFFFFFF
        if a > 1:
            machine.fail[a:b] = machine.step(machine.fail[above].astype(np.int64), word)
        own = machine.report[a:b]
        machine.report[a:b] = np.where(own > 0, own, machine.report[machine.fail[a:b]])
    return machine


def ship_automaton(benchmark: DataFrame, item_id: str, text: str) -> str:
    """Builds the automaton of a benchmark and gives the name under which executors find its file.

    Items stream through the driver, which keeps four bytes a word; the file has up to 208 bytes a word.
    """
    spark = benchmark.sparkSession
    machine = build_automaton(benchmark.select(item_id, text).where(F.col(text).isNotNull()).toLocalIterator())
    folder, name = new_folder(spark, "automaton"), f"automaton-{uuid.uuid4().hex}.arrow"
    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(top)
    with store.open_output_stream(f"{top}/{name}") as out:
        machine.write(out)
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


@lru_cache(maxsize=2)
def _opened(name: str) -> Automaton:
    return Automaton.open(SparkFiles.get(name))


def _scanner(name: str, text: str, kept: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _opened(name)
        for part in slices(batches, text):
            found = machine.scan(texts(part.column(text)))
            hits = np.concatenate([[0], np.cumsum(found.hit)])[found.first]
            columns = [
                pa.array([sorted(x) for x in found.items], pa.list_(pa.string())), pa.array(np.diff(found.first), pa.int64()),
                pa.array([[{"start": a, "stop": b} for a, b in found.spans(i)] for i in range(part.num_rows)], _RANGES), pa.array(np.diff(hits), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], [*kept, "items", "n_words", "spans", "n_hit"])

    return run


_RANGES = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (its columns in ``keep``, all by default) with ``items`` (ids as strings, sorted), ``n_words``, ``spans``, ``n_hit``, ``contaminated``.

    Words are runs of a-z (A-Z lowered), 0-9 and non-ASCII characters. A window is 13 consecutive
    words of an item, or the whole of a shorter item. A word inside an occurrence of a window is
    hit; a row is contaminated if a twentieth of its words or more are. ``spans`` has the ranges of
    the original text, ``start`` to ``stop`` in characters, that runs of hit words cover.

    One automaton over word numbers holds the whole benchmark, built once and mapped from a file by
    all workers, which read each text once.

    Null or empty text has no words and isn't contaminated; null or empty items have no windows;
    items that repeat each count by id. A long text is scanned whole, in memory in proportion to it.
    Repeated rows come out repeated; empty tables work. The names of the added columns are
    replaced if present; other columns pass through.
    """
    sent, kept, schema = with_text(docs.drop("items", "n_words", "spans", "n_hit", "contaminated"), text, keep)
    added = "items array<string>, n_words bigint, spans array<struct<start:int,stop:int>>, n_hit bigint"
    found = map_arrow(sent, _scanner(ship_automaton(benchmark, item_id, item_text), text, kept), f"{schema}, {added}")
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (HIT_SHARE * F.col("n_hit") >= F.col("n_words")))
