"""Conversation repair and the Merkle manifest against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from panelwright.llm import conversations, manifest, queries

SF = "/root/testdata/sf0.01"
NAMES = {"u": "user", "a": "assistant"}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def every_repair(rows):
    """The cheapest repair, ties by letters, over all edits with up to two inserts at the end and one before each row."""
    best = None
    choices = [[("D", None, 4)] + ([] if fault in (1, 2) else [("K", (role, text), more), ("R", ("user", text), 3 + more), ("R", ("assistant", text), 3 + more)]) for role, text, fault in rows for more in [3 * (fault == 3)]]
    for gaps in itertools.product(*[["", "u", "a"]] * len(rows), ["", "u", "a", "ua", "au"]):
        for chosen in itertools.product(*choices):
            cost, letters, out = sum(c[2] for c in chosen) + 3 * sum(map(len, gaps)), "", []
            for gap, edit in itertools.zip_longest(gaps, chosen):
                letters += "I" * len(gap)
                out += [(NAMES[x], "") for x in gap]
                if edit:
                    letters += edit[0]
                    out += [edit[1]] * (edit[1] is not None)
            if (best is None or (cost, letters) < best[:2]) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)):
                best = cost, letters, out
    return best


def repaired(rows):
    letters, out = [], []

    def put(edit, role, text):
        letters.append(edit[0])
        if edit != "Delete":
            out.append((role, text))

    machine = conversations.Viterbi(put)
    for role, text, fault in rows:
        machine.delete() if fault in (1, 2) else machine.row(role, text, fault == 3)
    return machine.end(), "".join(letters), out


def string_repair(rows):
    """Without a tree: each state keeps its whole letters and rows; inserts are tried before each row and at the end."""
    follow = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    states = {0: (0, "", ())}

    def better(found, state, new):
        if state not in found or new[:2] < found[state][:2]:
            found[state] = new

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for s, (c, w, o) in [*out.items()]:
                for x, to in follow[s].items():
                    if x in NAMES:
                        better(out, to, (c + 3, w + "I", (*o, (NAMES[x], ""))))
        return out

    for role, text, fault in rows:
        found = {}
        for s, (c, w, o) in states.items():
            better(found, s, (c + 4, w + "D", o))
        if fault not in (1, 2):
            for s, (c, w, o) in inserted(states).items():
                for x, to in follow[s].items():
                    more = 3 * (fault == 3)
                    if role[:1] == x:
                        better(found, to, (c + more, w + "K", (*o, (role, text))))
                    elif x in NAMES:
                        better(found, to, (c + 3 + more, w + "R", (*o, (NAMES[x], text))))
        states = found
    cost, letters, out = min(inserted(states)[s] for s in (0, 3) if s in inserted(states))
    return cost, letters, list(out)


def test_repair_is_the_cheapest_of_all():
    draw = random.Random(5)
    for _ in range(250):
        rows = [(draw.choice(["user", "assistant", "system", "user", "assistant", "x", ""]), f"t{i}", draw.choice([0, 0, 0, 1, 2, 3, 3])) for i in range(draw.choice([0, 1, 2, 3, 3]))]
        assert repaired(rows) == every_repair(rows), rows


def test_repair_of_long_conversations():
    draw = random.Random(6)
    for kinds, faults in ((["user", "assistant", "system", "tool"], [0, 0, 0, 1, 2, 3]), (["user"], [0]), (["user", "assistant"], [0, 0, 3]), (["system"], [0, 2]), (["assistant", "assistant", "user"], [0, 3])):
        for n in (1, 2, 7, 60, 61):
            rows = [(draw.choice(kinds), f"t{i}", draw.choice(faults)) for i in range(n)]
            assert repaired(rows) == string_repair(rows), rows


def test_settled_edits_leave_while_rows_come():
    draw, out = random.Random(7), []
    machine = conversations.Viterbi(lambda *edit: out.append(edit))
    held = []
    for i in range(20_000):
        machine.row(("user", "assistant")[i % 2] if draw.random() < 0.9 else "system", "t", draw.random() < 0.1)
        if i % 1000 == 0:
            held.append(i - len(out))
    assert max(held) < 60
    for _ in range(100_000):
        machine.delete()
    assert len(machine.root.kids) <= 3


CONVERSATIONS = [
    (-1, None, None, None), (-1, None, "user", "Hi."), (-1, None, "assistant", "Hi."), (None, 0, "user", "No id."), (None, 0, "user", "No id."), (-2, 5, "tool", "x"), (-3, 1, "", "a."), (-3, 9, "user", "a."),
    (-4, 0, "user", "long. " * 40_000), (-4, 0, "user", "long. " * 40_000), (-4, 2, "assistant", " "), (-5, 1, "system", "s?"), (-5, 2, "system", "s?"), (-6, 0, "user", "  \t\n"), (-6, 0, "user", ""),
]


@pytest.fixture(scope="module")
def talks(tmp_path_factory):
    top = tmp_path_factory.mktemp("talks")
    t = pq.read_table(f"{SF}/conversations.parquet")
    rows = [*zip(*(t[c].to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True), *CONVERSATIONS, *((-9, i, ("user", "assistant")[i % 3 % 2], f"say {i % 40}{'.' * (i % 7 > 0)}") for i in range(700))]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
    pq.write_table(pa.table([*columns, columns[3]], ["conv_id", "turn", "role", "text", "fault"]), top / "conversations.parquet")
    return str(top), rows


def plain_damage(rows):
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        yield from [(conv, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)


def test_repair_query(spark, talks):
    folder, rows = talks
    by = {r[0]: [] for r in rows}
    for r in plain_damage(rows):
        by[r[0]].append(r[1:])
    want = {}
    for conv, talk in by.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, marked = set(), {1: 0, 2: 0, 3: 0}, []
        for turn, role, text in talk:
            seenable = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 1 if not seenable else 2 if (role, text) in seen else 3 if seenable[-1] not in ".!?" else 0
            seen.add((role, text))
            faults[fault] = faults.get(fault, 0) + 1
            marked.append((role, text, fault))
        turns = {t for t, _, _ in talk if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(talk))
        cost, letters, out = string_repair(marked)
        want[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults[1], faults[2], faults[3], illegal, cost, letters, sha("\n".join(f"{r}:{t}" for r, t in out)))
    got = queries.op11_survivor_coalescence_repair(spark, folder)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and {r[0]: r[1:] for r in found} == want
    listed = conversations.edits(conversations.damage(spark.read.parquet(f"{folder}/conversations.parquet")), F.col("present")).collect()
    for conv, (*_, letters, digest) in want.items():
        mine = sorted((r for r in listed if r["conv_id"] == conv), key=lambda r: r["nr"])
        assert [r["nr"] for r in mine] == [*range(len(letters))] and "".join(r["edit"][0] for r in mine) == letters
        assert sha("\n".join(f"{r['role']}:{r['text']}" for r in mine if r["edit"] != "Delete")) == digest


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.summaries(empty).count() == conversations.edits(empty).count() == conversations.damage(empty).count() == 0


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def plain_manifest(rows):
    def hashed(*values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = {}
    for doc, source, lang, n, text in rows:
        groups.setdefault(lang, []).append((doc, hashed(doc, source, lang, n, text), hashed(doc, source, lang, None if n is None else n + 1, text)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([r[1] for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]) for g in order}
    top = levels([trees[g][-1][0] for g in order])

    def up(tree, at, digest):
        found = []
        for level in tree[:-1]:
            other = level[at ^ 1] if at ^ 1 < len(level) else None
            digest = sha(digest) if other is None else sha(other + digest) if at & 1 else sha(digest + other)
            found += [other] * (other is not None)
            at >>= 1
        return digest, found

    for k, g in enumerate(order):
        for at, (doc, leaf, changed) in enumerate(sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))):
            spoilt = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0
            sub, beside = up(trees[g], at, changed if spoilt else leaf)
            root, over = up(top, k, sub)
            yield doc, leaf, trees[g][-1][0], top[-1][0], sha("".join(beside + over)), root, root == top[-1][0]


@pytest.mark.parametrize("height", [1, 3, 12])
def test_manifest_query(spark, tmp_path, rows, height, monkeypatch):
    monkeypatch.setattr(manifest.manifest, "__defaults__", (None, height))
    n = len(rows)
    table = [(doc, [None, "web", "é"][i % 3], [None, "de", "", "é", "z", "en"][i % 6 if i % 11 else 5], None if i % 13 == 0 else len(text or ""), text) for i, (doc, text) in enumerate(rows)]
    table += [(7, "one", "alone", 1, "x")]
    table = table if height > 1 else [r for i, r in enumerate(table) if i % 4 == 0]
    columns = [pa.array(c, k) for c, k in zip(zip(*table, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)]
    pq.write_table(pa.table([*columns, columns[4], columns[4]], ["doc_id", "source", "lang", "n_chars", "text", "tree", "place"]), tmp_path / "documents.parquet")
    got = queries.op13_octopus_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = sorted(plain_manifest(table), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and n > 100
    assert {w[-1] for w in want} == {True, False}


def test_manifest_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert manifest.manifest(empty, "lang", "doc_id", ["doc_id", "text"]).count() == 0
    one = manifest.manifest(spark.createDataFrame([(1, None, "x")], empty.schema), "lang", "doc_id", ["doc_id", "text"]).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] == sha("1:11:x") and one["proof_sha256"] == sha("")


def test_octopus_asks_for_no_node_that_follows():
    draw = random.Random(3)
    for _ in range(200):
        n = draw.randint(1, 70)
        tree = levels([sha(str(i)) for i in range(n)])
        known = sorted(draw.sample(range(n), draw.randint(1, n)))
        asked = manifest.missing(np.array(known), n)
        have = {(0, i) for i in known} | {*asked}
        for at in range(manifest.height(n)):
            for i in range(0, len(tree[at]), 2):
                pair = {(at, j) for j in (i, i + 1) if j < len(tree[at])}
                if pair <= have:
                    assert (at + 1, i >> 1) not in asked
                    have.add((at + 1, i >> 1))
        assert (manifest.height(n), 0) in have
        assert all(not {(at - 1, 2 * i), (at - 1, 2 * i + 1)} & have for at, i in asked if at)  # nothing known lies below what is asked for
        assert not {*asked} & {(0, i) for i in known}
