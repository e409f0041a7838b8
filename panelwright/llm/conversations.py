"""Repair of conversation structure: least-cost edits that leave roles in order, decided while rows stream by.

A repaired conversation is empty, or an optional system row and then user and assistant in turns.
Rows are kept (0), given another role (3) or deleted (4); empty user and assistant rows may be
inserted (3); a truncated row that stays adds 3. Blank rows and repeats of an earlier row must go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.runtime import map_arrow

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What the roles so far read as: nothing, ``s``, something that ends in ``u``, something that ends in ``a``.
_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state that an initial leads to from each state, and the empty row that may be inserted there.
_NEXT = ({"s": _SYSTEM, "u": _USER}, {"u": _USER}, {"a": _ASSISTANT}, {"u": _USER})
_ROLE = {"u": "user", "a": "assistant"}
#: ``_WORTH[i][j]``: what goes on from state i can go on from state j for at most so much more.
_WORTH = ((0, 6, 7, 4), (0, 0, 3, 0), (3, 3, 0, 3), (0, 6, 3, 0))
_BLANKS = " \t\n\x0b\x0c\r"
_GONE, _SOUND, _BLANK, _DUPLICATE, _CUT = -1, 0, 1, 2, 3


def damage(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, present)``: the rows with faults planted by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops a row (``present`` is false, so that its conversation isn't forgotten), 1 empties its
    text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes it the user's. Nulls count as one space:
    as role, as text, and in the key. Other columns are left out; an empty table stays empty.
    """
    code = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))) % 20
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (code != 0).alias("present"),
        F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


class _Node:
    """An edit of one survivor's past, with the blank or repeated rows deleted after it; ``kids`` counts who leads back to it."""

    __slots__ = ("deleted", "inserted", "kids", "parent", "row", "step")

    def __init__(self, parent: _Node | None, step: str, inserted: str | None, row: tuple[str, str] | None):
        self.parent, self.step, self.inserted, self.row = parent, step, inserted, row
        self.kids: list[_Node] = []
        self.deleted = 0


class Viterbi:
    """The cheapest edits of one conversation, given out as soon as all survivors agree on them.

    Each state of the role grammar has one survivor, a leaf of a tree of back pointers. A leaf that
    dies takes along the nodes that nothing else refers to; what then hangs on one branch below the
    root is common to all survivors and leaves. A survivor also dies once another one can go on as
    it would and still be cheaper, so that the past settles within few rows.

    Of equally cheap pasts the one whose letters sort first stays. No two survivors' unresolved
    letters are a prefix of each other (both have dealt with the same rows, inserts standing before
    the row that needs them), so that the order of the complete suffixes never changes once they
    differ: it is carried along as each survivor's rank.
    """

    def __init__(self, put: Callable[[str, str | None, str | None], None]):
        self.put = put
        self.root = _Node(None, "", None, None)
        self.alive: dict[int, tuple[int, int, _Node]] = {_NOTHING: (0, 0, self.root)}

    def delete(self) -> None:
        """A row that every survivor must delete: no survivor's standing changes, and no node is needed."""
        for state, (cost, rank, node) in self.alive.items():
            node.deleted += 1
            self.alive[state] = cost + DELETE, rank, node

    def row(self, role: str, text: str, truncated: bool) -> None:
        best: dict[int, tuple] = {}
        more = TRUNCATED if truncated else 0

        def offer(state: int, found: tuple) -> None:
            if state not in best or found[:3] < best[state][:3]:
                best[state] = found

        for state, (cost, rank, node) in self.alive.items():
            offer(state, (cost + DELETE, rank, "D", node, None, None))
            middle = "a" if state == _USER else "u"
            for at, letters, paid, inserted in ((state, "", cost, None), (_NEXT[state][middle], "I", cost + INSERT, _ROLE[middle])):
                for initial, to in _NEXT[at].items():
                    if role[:1] == initial:
                        offer(to, (paid + KEEP + more, rank, letters + "K", node, inserted, (role, text)))
                    elif initial in _ROLE:
                        offer(to, (paid + REROLE + more, rank, letters + "R", node, inserted, (_ROLE[initial], text)))
        stay = {i: found for i, found in best.items() if not any(found[0] > other[0] + _WORTH[i][j] for j, other in best.items())}
        ranks = {state: k for k, state in enumerate(sorted(stay, key=lambda s: stay[s][1:3]))}
        before, self.alive = self.alive, {}
        for state, (cost, _, letters, parent, inserted, row) in stay.items():
            node = _Node(parent, letters, inserted, row)
            parent.kids.append(node)
            self.alive[state] = cost, ranks[state], node
        for _, _, node in before.values():
            self._release(node)
        self._settle()

    def _release(self, node: _Node) -> None:
        while not node.kids and node is not self.root:
            node.parent.kids.remove(node)
            node = node.parent

    def _settle(self) -> None:
        while len(self.root.kids) == 1 and self.root.kids[0].kids:
            self._give(self.root)
            self.root = self.root.kids[0]
            self.root.parent = None

    def _give(self, node: _Node) -> None:
        if node.inserted:
            self.put("Insert", node.inserted, "")
        if node.step:
            self.put({"K": "Keep", "R": "Rerole", "D": "Delete"}[node.step[-1]], *(node.row or (None, None)))
        for _ in range(node.deleted):
            self.put("Delete", None, None)

    def end(self) -> int:
        """Gives out all that is left and returns the cost."""
        missing = {_NOTHING: "", _SYSTEM: "ua", _USER: "a", _ASSISTANT: ""}
        cost, _, state = min((cost + INSERT * len(missing[s]), rank, s) for s, (cost, rank, _) in self.alive.items())
        path, node = [], self.alive[state][2]
        while node is not None:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self._give(node)
        for initial in missing[state]:
            self.put("Insert", _ROLE[initial], "")
        return cost


_UNSEEN = object()


class _Conversation:
    """Counts and repair of one conversation, fed in order; ``put`` gets ``(edit, role, text)`` of each edit in order."""

    def __init__(self, put: Callable[[str, str | None, str | None], None]):
        self.viterbi = Viterbi(put)
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: object = _UNSEEN

    def row(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if fault == _GONE:
            return
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        self.illegal += self.before is not _UNSEEN and self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        if fault in (_BLANK, _DUPLICATE):
            self.blank += fault == _BLANK
            self.duplicate += fault == _DUPLICATE
            self.viterbi.delete()
        else:
            self.truncated += fault == _CUT
            self.viterbi.row(role, text, fault == _CUT)

    def end(self) -> tuple[int, ...]:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.viterbi.end()


def _ordered(rows: DataFrame, present: Column | None) -> DataFrame:
    """Each conversation's rows in order within one partition, with their first fault; texts that will go aren't sent on.

    One exchange, by conversation: the window over equal rows and the sort find the rows in place.
    """
    there = F.lit(True) if present is None else present
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), there.alias("there")).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "there", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    end = F.rtrim("text", F.lit(_BLANKS))
    fault = F.when(~F.col("there"), _GONE).when(end == "", _BLANK).when(F.col("again"), _DUPLICATE).when(~F.right(end, F.lit(1)).isin(*".!?"), _CUT).otherwise(_SOUND)
    rows = rows.withColumn("again", again).withColumn("fault", fault).sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "again")
    return rows.select("conv_id", "turn", "role", F.when(F.col("fault").isin(_SOUND, _CUT), F.col("text")).alias("text"), "fault")


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _digesting(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []
    now: object = _UNSEEN
    audit, digest, talk = bytearray(), hashlib.sha256(), None
    schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def put(edit: str, role: str | None, text: str | None) -> None:
        nonlocal first
        audit.extend(edit[0].encode())
        if edit != "Delete":
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False

    def close() -> None:
        if talk is not None:
            done.append((now, *talk.end(), audit.decode(), digest.hexdigest()))

    first = True
    for conv, turn, role, text, fault in _streamed(batches):
        if conv != now or now is _UNSEEN:
            close()
            if len(done) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
                done = []
            now, audit, digest, first = conv, bytearray(), hashlib.sha256(), True
            talk = _Conversation(put)
        talk.row(turn, role, text, fault)
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)


def _editing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("nr", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    held: list[tuple] = []
    now: object = _UNSEEN
    talk, nr, size = None, 0, 0

    def put(edit: str, role: str | None, text: str | None) -> None:
        nonlocal nr, size
        held.append((now, nr, edit, *((None, None) if edit == "Delete" else (role, text))))
        nr, size = nr + 1, size + 64 + len(text or "")

    for conv, turn, role, text, fault in _streamed(batches):
        if conv != now or now is _UNSEEN:
            if talk is not None:
                talk.end()
            now, nr, talk = conv, 0, _Conversation(put)
        talk.row(turn, role, text, fault)
        if size > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held.clear()
            size = 0
    if talk is not None:
        talk.end()
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def edits(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """``(conv_id, nr, edit, role, text)``: the cheapest edits of each conversation in order, with the row as it is then.

    ``rows`` has ``conv_id`` (an integer), ``turn``, ``role`` and ``text``; other columns don't
    matter, whatever their names. A conversation's rows go by turn, null turns first; rows of one
    turn by role and text. Null roles and texts count as one space: such a text is blank, such a
    role fits nowhere and is changed or deleted. Null ids are one conversation. Rows that repeat
    are duplicates of their first. Deleted rows have neither role nor text. ``present`` false
    leaves a row out. An empty table gives no rows.

    Rows stream through one task a conversation, sorted on disk by Spark if need be, and edits leave
    it once they are settled: neither a long conversation nor a long text is held whole elsewhere
    than in its own row.
    """
    return map_arrow(_ordered(rows, present), _editing, "conv_id bigint, nr bigint, edit string, role string, text string")


def summaries(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """A row for each ``conv_id`` of ``rows``: its faults, the cost of its repair, the edits' initials and the repaired text's SHA-256.

    Cases are as in ``edits``; a conversation of which no row is present has zeros, no edits and
    the digest of the empty string. The digest is taken as edits settle: SHA-256 reads in order, so
    that one task must see a conversation's repaired text, but none of it is kept.
    """
    kinds = ", ".join(f"{n} bigint" for n in COUNTS)
    return map_arrow(_ordered(rows, present), _digesting, f"conv_id bigint, {kinds}, audit string, repaired_sha256 string")
