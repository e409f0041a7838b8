"""Operators over groups of rows against brute force: line dedup, sharding, SimHash, WARC, LM, pipeline."""

import base64
import gzip
import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from panelwright.llm import line_dedup, lm, queries, sharding, simhash, warc
from panelwright.llm.components import connected_components
from panelwright.llm.runtime import new_folder


def _groups(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return [top(i) for i in range(n)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 100 + i) for i in range(40)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in [*range(100, 140), 200]}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def _lines_kept(rows):
    """Brute force: all pairs of lines by exact Jaccard similarity, single linkage, first place stays."""
    first = {}
    for doc, text in sorted(rows):
        for p, line in enumerate(text.split("\n")):
            if norm := line.strip(" ").lower():
                first.setdefault(norm, []).append((doc, p))
    keys = [*first]
    sets = [{k[i : i + 8] for i in range(max(1, len(k) - 7))} for k in keys]
    links = [(i, j) for i in range(len(keys)) for j in range(i) if 0.8 * max(len(sets[i]), len(sets[j])) <= min(len(sets[i]), len(sets[j])) and 5 * (c := len(sets[i] & sets[j])) >= 4 * (len(sets[i]) + len(sets[j]) - c)]
    group = dict(zip(keys, _groups(len(keys), links), strict=True))
    best = {}
    for k in keys:
        best[group[k]] = min(best.get(group[k], (math.inf, 0)), min(first[k]))
    return {doc: "\n".join(line for p, line in enumerate(text.split("\n")) if not line.strip(" ") or best[group[line.strip(" ").lower()]] == (doc, p)) for doc, text in rows}


def test_line_dedup_against_brute_force(spark, docs, rows):
    plain = [(d, t) for d, t in rows if d is not None and t is not None and d not in (900_006, 900_009)]
    want = _lines_kept(plain)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs.where("doc_id is not null and text is not null and doc_id not in (900006, 900009)")).collect()}
    wrong = [d for d in want if got[d]["text"] != want[d]]
    assert len(wrong) <= 2  # banding finds 99 % of the links at 0.8
    assert sum(r["n_dropped"] for r in got.values()) > 50


@pytest.mark.parametrize("paired", [2048, 4])
def test_line_dedup_tries_all_pairs_of_a_bucket(spark, monkeypatch, paired):
    """Many families with one long passage at 0.65 and a near copy each: every pair that meets in a bucket and is alike is linked."""
    monkeypatch.setattr(line_dedup, "PAIRED", paired, raising=False)
    rng = np.random.default_rng(6)
    word = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    passage = word(160)
    norms = [passage + family + word(8) for family in (word(15) for _ in range(250)) for _ in range(2)]
    lines = spark.createDataFrame([(i, i, 0, x) for i, x in enumerate(norms)], "_key long, _hash long, pos int, norm string").selectExpr("*", "xxhash64(norm) AS line")
    found = lines.collect()
    place = {r["line"]: r["_key"] for r in found}
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} for x in norms]
    alike = {(i, j) for j in range(len(norms)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert 200 < len(alike) < 2000
    got = {place[r["line"]]: place[r["group"]] for r in line_dedup.duplicate_lines(*line_dedup.told_apart(lines)).collect()}
    buckets = {}
    for r in line_dedup._bands(lines).collect():
        buckets.setdefault(r["band"], set()).add(place[r["line"]])
    meets = {p for p in alike if any(p[0] in b and p[1] in b for b in buckets.values())}
    assert max(map(len, buckets.values())) > 50
    want = _groups(len(norms), meets)
    same = lambda groups: {(i, j) for j in range(len(norms)) for i in range(j) if groups[i] == groups[j]}
    assert len(meets) > 0.9 * len(alike) and same([got.get(i, -1 - i) for i in range(len(norms))]) == same(want)


def test_line_dedup_merges_crowded_buckets_before_it_pairs(spark, monkeypatch):
    """Of very many lines that are nearly alike, groups merge along pivots, so that few pairs are left; the groups are those of all pairs."""
    rng = np.random.default_rng(8)
    word = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    base = word(300)
    norms = [base[:at] + word(n) + base[at + n :] for at, n in zip(rng.integers(0, 285, 500), rng.integers(9, 15, 500), strict=True)]
    lines = spark.createDataFrame([(i, i, 0, x) for i, x in enumerate(norms)], "_key long, _hash long, pos int, norm string").selectExpr("*", "xxhash64(norm) AS line")
    members, bodies = line_dedup._members(line_dedup.told_apart(lines)[1]), lines.select("line", "norm")
    sketches, none = line_dedup._sketched(bodies), spark.createDataFrame([], "line long, group long")
    made, across = [], line_dedup._across
    monkeypatch.setattr(line_dedup, "_across", lambda *a: [made.append(across(*a).count()), across(*a)][1])
    found = {tuple(r) for r in line_dedup._rest(members, bodies, sketches, none).collect()}
    few = sum(made)
    monkeypatch.setattr(line_dedup, "CROWDED", math.inf, raising=False)
    assert found == {tuple(r) for r in line_dedup._rest(members, bodies, sketches, none).collect()}
    assert 4 * few < sum(made) - few, made


def test_line_dedup_takes_one_turn_of_pivots(monkeypatch):
    """A turn costs dozens of small stages, so that there is one, however crowded the buckets stay; what the groups are, the test above holds."""
    rows = type("Rows", (), {"left": 1, "take": lambda self, n: [0] * self.left})
    linked, none, turns = rows(), rows(), []
    none.left = 0
    monkeypatch.setattr(line_dedup, "_mixed", lambda members, groups: (none, True))
    monkeypatch.setattr(line_dedup, "_pivoted", lambda *a: [turns.append(1), linked][1])
    monkeypatch.setattr(line_dedup, "_merged", lambda groups, links: groups + 1)
    assert line_dedup._rest(None, None, None, 0) == 1 and len(turns) == 1


def test_lines_of_equal_hashes_are_told_apart(spark, docs, monkeypatch):
    want = sorted(map(tuple, line_dedup.dedup_lines(docs).select("doc_id", "text", "n_dropped").collect()), key=repr)
    monkeypatch.setattr(line_dedup, "_line_hash", lambda norm: F.xxhash64(norm) % 50)
    weak = line_dedup.dedup_lines(docs)
    assert sorted(map(tuple, weak.select("doc_id", "text", "n_dropped").collect()), key=repr) == want


def test_line_dedup_edges(spark, docs, clashing, empty):
    got = line_dedup.dedup_lines(docs)
    assert got.count() == docs.count() and got.where("doc_id = 900001 and text is null and n_lines = 0").count() == 1
    assert got.where("doc_id = 900003 and n_dropped = 0").count() == 1
    assert [r["text"] for r in got.where("doc_id in (900004, 900005)").orderBy("doc_id").collect()] == ["One.", ""]
    assert got.where("doc_id = 900009").select("text").distinct().count() == 1
    assert got.where("doc_id = 900007").first()["text"] == "a\n\nb\n"
    assert line_dedup.dedup_lines(empty).count() == 0
    assert {r["items"] for r in line_dedup.dedup_lines(clashing).collect()} == {"x"}


@pytest.mark.parametrize("range_bytes", [64 << 20, 2000])
def test_shards(spark, docs, rows, empty, monkeypatch, range_bytes):
    monkeypatch.setattr(sharding, "RANGE_BYTES", range_bytes)
    got = sharding.shard_by_bytes(docs).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert all(sorted(r["slot"] for r in part) == list(range(len(part))) for part in by.values())
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert all(abs(sum(r["size"] for r in part) - total / 16) <= largest for part in by.values())
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    assert sharding.shard_by_bytes(empty).count() == 0


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark, folder, rows):
    prints = [_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    group = _groups(len(rows), links)
    least = {}
    for (doc, _), g in zip(rows, group, strict=True):
        if doc is not None:
            least[g] = min(least.get(g, doc), doc)
    want = Counter((doc, f"{p:016x}", least.get(g)) for (doc, _), p, g in zip(rows, prints, group, strict=True))
    assert Counter(map(tuple, queries.op9_pigeonring_simhash(spark, folder).collect())) == want


@pytest.mark.parametrize("paired", [128, 3])
def test_hamming_links_join_the_right_components(spark, monkeypatch, paired):
    """Random prints with near ones planted, among them a bucket of many: pairs and masked files agree with brute force."""
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    prints = set(base)
    for x in base[:20]:
        for _ in range(6):
            prints.add(x ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    prints = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    links = [(i, j) for i in range(len(prints)) for j in range(i) if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 2]
    found = simhash.hamming_links(spark.createDataFrame([(p,) for p in prints], "print long")).collect()
    place = {p: i for i, p in enumerate(prints)}
    mine = [(place[r["u"]], place[r["v"]]) for r in found]
    assert {tuple(sorted(x)) for x in mine} <= {tuple(sorted(x)) for x in links}
    assert _groups(len(prints), mine) == _groups(len(prints), links)


def test_keep_one(spark, docs, rows, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 900009").count() == 1
    assert kept.where("doc_id in (900001, 900002, 900003)").count() <= 1 and kept.where("doc_id is null").count() == 1
    assert simhash.keep_one(empty).count() == 0


def test_warc_query(spark, folder):
    pages = [(r["page_id"], r["html"] or "") for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    first = {}
    for page, html in sorted(pages):
        first.setdefault(html, page)
    want = set()
    for page, html in pages:
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        own = first[html] == page
        want.add((page, len(html.encode()), digest, "response" if own else "revisit", None if own else first[html]))
    assert set(map(tuple, queries.op6_salvage_warc(spark, folder).collect())) == want


def test_warc_edges(spark):
    rows = [(1, "http://a b\n", "same"), (2, None, "same"), (None, "u", "same"), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\x1f\u008b\x08 inside"), (1, "http://a b\n", "same")]
    folder = new_folder(spark, "warc")
    assert warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder) == len(rows)
    got = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archives(spark, folder).collect())
    assert got == Counter([(1, "response", None, 4), (1, "response", None, 4), (2, "revisit", 1, 4), (None, "revisit", 1, 4), (3, "response", None, 0), (4, "revisit", 3, 0), (5, "response", None, 21)])
    none = new_folder(spark, "warc")
    assert warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), none) == 0
    assert warc.read_archives(spark, none).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_warc_salvage(packed):
    records = [warc.record(i, f"http://x/{i}", f"payload {i} WARC/1.1 inside".encode() * 40, None, False) for i in range(6)]
    parts = [gzip.compress(r) if packed else r for r in records]
    parts[1] = parts[1][:60] + b"\xff\x00" + parts[1][62:]  # damaged
    parts[3] = parts[3][: len(parts[3]) // 2]  # cut
    data = b"junk" + b"".join(parts)
    found = [*warc.salvage(data)]
    assert [warc._number(x.headers["warc-record-id"]) for x in found if not x.gap] == [0, 2, 4, 5]
    assert [(a.end, b.start) for a, b in zip(found, found[1:], strict=False)] == [(b.start, b.start) for b in found[1:]]
    assert found[0].gap and found[0].start == 0 and found[-1].end == len(data) and sum(bool(x.gap) for x in found) == 3


def test_warc_salvage_inside_members_and_other_writers():
    """Sound records around a damaged one of one gzip member; header names in any case, values without a blank."""
    each = [bytearray(warc.record(i, f"http://x/{i}", f"page {i} body".encode(), None, False)) for i in range(3)]
    each[1][each[1].index(b"body")] ^= 1
    found = [*warc.salvage(gzip.compress(b"".join(each)))]
    assert [warc._number(x.headers["warc-record-id"]) for x in found if not x.gap] == [0, 2] and [x.gap for x in found if x.gap] == ["in member: bad digest"]
    other = b"WARC/1.0\r\nwarc-type:resource\r\nWARC-RECORD-ID: <urn:page:7>\r\ncontent-length:5\r\n\r\nhello\r\n\r\n"
    found = [*warc.salvage(other + gzip.compress(other))]
    assert [(x.gap, warc._number(x.headers["warc-record-id"])) for x in found] == [(None, 7)] * 2


def test_warc_reads_in_time_that_grows_with_the_archive():
    member = gzip.compress(warc.record(1, "http://x", bytes(range(256)) * 8, None, False))
    seconds = []
    for n in (500, 4000):
        began = time.thread_time()
        assert sum(not x.gap for x in warc.salvage(member * n)) == n
        seconds.append(time.thread_time() - began)
    assert seconds[1] < 20 * seconds[0]


def test_lm_base_counts(spark, folder, rows):
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 5 == 1
    words = [(d, (t or "").encode().lower().split()) for d, t in rows]
    counts = Counter(w for d, ws in words if not held(d) for w in ws)
    texts = sum(not held(d) for d, _ in words)
    n, base = sum(counts.values()) + texts, None
    base = n + 0.5 * (len(counts) + 1 + 1)
    want = sorted(((d, held(d), len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, n, round(sum(math.log10((counts[w] + 0.5) / base) for w in ws) + math.log10((texts + 0.5) / base), 5)) for d, ws in words), key=repr)
    found = queries.op4_attention_lm_scores(spark, folder).collect()
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in found), key=repr)
    assert got == want and all(r["score"] < 0 for r in found)


def _random_model():
    counts = np.random.default_rng(0).integers(0, 50, lm.VOCABULARY).astype(float)
    model = lm.initial(counts)
    model.flat += np.random.default_rng(1).normal(0, 0.2, len(model.flat)).astype(np.float32)
    return model


def test_lm_gradient_and_probability():
    model = _random_model()
    rng = np.random.default_rng(2)
    inputs, targets = rng.integers(0, lm.VOCABULARY, (2, lm.WINDOW)), rng.integers(0, lm.VOCABULARY, (2, lm.WINDOW))
    targets[1, 20:] = lm.PAD
    model.flat = model.flat.astype(np.float64)
    _, g = lm.gradient(model, inputs, targets)
    for at in [*rng.integers(0, len(model.flat), 4), *np.argsort(-np.abs(g))[:12]]:
        keep, step = model.flat[at], 1e-5
        model.flat[at] = keep + step
        up, _ = lm.gradient(model, inputs, targets)
        model.flat[at] = keep - step
        down, _ = lm.gradient(model, inputs, targets)
        model.flat[at] = keep
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=1e-3, abs=1e-6)


@pytest.mark.parametrize("wide", [1.0, 300.0])
def test_lm_softmax_over_seen_terms(wide):
    """Within bounds and beyond them; terms that aren't seen have no part, a row that sees none is zero."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(3, 5, 8)) * wide).astype(np.float32)
    seen = rng.random((3, 5, 8)) < 0.6
    seen[0, 0] = False
    least = np.where(seen, x.astype(float), -np.inf)
    terms = np.exp(least - least.max(axis=-1, keepdims=True, initial=-1e9))
    want = terms / np.maximum(terms.sum(axis=-1, keepdims=True), 1e-300)
    got = lm._softmax(x.copy(), seen)
    live = seen.any(axis=-1)
    assert got[live] == pytest.approx(want[live], abs=1e-5) and not got[0, 0].any()


def test_lm_places_before_the_first_target_are_only_looked_at(monkeypatch):
    """Hidden states are made where tokens are scored, a quarter of a window less; the gradient is that of all places."""
    made, tanh = [], np.tanh
    monkeypatch.setattr(lm.np, "tanh", lambda x: [made.append(x.shape[1]), tanh(x)][1])
    model = _random_model()
    lm.gradient(model, *lm._windows(np.random.default_rng(4).integers(0, lm.VOCABULARY, 130), np.array([0, 130])))
    assert made == [lm.STEP]


def test_lm_scores_each_token_once_and_sums_to_one():
    scorer = lm.Scorer(_random_model())
    rng = np.random.default_rng(3)
    long = rng.integers(0, lm.VOCABULARY, 75)
    inputs, targets, owner = lm.blocks(np.concatenate([long, long[:1]]), np.array([0, 75, 75, 76]))
    assert (targets != lm.PAD).sum() == 76 and np.bincount(owner, minlength=3).tolist() == [-(-75 // lm.STEP), 0, 1]
    assert targets[targets != lm.PAD].tolist() == [*long.tolist(), long[0]]
    every = np.tile(inputs[:1], (lm.VOCABULARY, 1))
    wanted = np.full((lm.VOCABULARY, lm.STEP), lm.PAD, np.int32)
    wanted[:, 7] = np.arange(lm.VOCABULARY)
    assert np.exp(scorer.windows(every, wanted)[:, 7]).sum() == pytest.approx(1, abs=1e-3)
    changed = long.copy()
    changed[40:] = 0
    a, b = (scorer.windows(*lm.blocks(x, np.array([0, 75]))[:2]).ravel()[:40] for x in (long, changed))
    assert np.allclose(a[:40], b[:40])  # later tokens don't matter to earlier ones


@pytest.mark.parametrize("safe", [True, False])
def test_lm_scorer_against_the_plain_forward_pass(safe):
    """Looked-up keys and values give the loss that the training pass multiplies out, with and without the largest term subtracted."""
    model = _random_model()
    scorer = lm.Scorer(model)
    scorer.safe = safe
    ids = np.random.default_rng(4).integers(0, lm.VOCABULARY, 130)
    inputs, targets = lm._windows(ids, np.array([0, 70, 71, 71, 130]))
    loss, _ = lm.gradient(model, inputs, targets)
    assert -scorer.windows(inputs, targets[:, lm.WINDOW - lm.STEP :]).sum() / 130 == pytest.approx(loss, rel=1e-4)
    assert -scorer.score(ids, np.array([0, 70, 71, 71, 130])).sum() * np.log(10) / 130 == pytest.approx(loss, rel=1e-4)


def test_lm_beats_its_unigram_on_held_out_text(rows):
    """Trained on part of the documents, the model gives others more than the smoothed unigram of the same subwords that it starts from."""
    subwords = lm.Subwords(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t for d, t in rows if d is not None and d < 900_000 and t]
    ids, starts = subwords.encode([lm.words_of(t) for t in texts[:150]])
    model = lm.initial(np.bincount(ids, minlength=lm.VOCABULARY).astype(float))
    held, held_starts = subwords.encode([lm.words_of(t) for t in texts[150:]])
    windows = lm._windows(held, held_starts)
    before, _ = lm.gradient(model, *windows[:, :400])
    made = np.random.default_rng(0).permutation(lm._windows(ids, starts), axis=1)
    for _ in range(2):
        lm.descend(model, ((made[0, i : i + 64], made[1, i : i + 64]) for i in range(0, made.shape[1], 64)), 0.005)
    after, _ = lm.gradient(model, *windows[:, :400])
    assert after < before - 0.2


def _batch(windows):
    targets = np.full((len(windows), lm.WINDOW), lm.PAD, np.int32)
    for row, ids in zip(targets, windows, strict=True):
        row[: len(ids)] = ids
    inputs = np.full_like(targets, lm.END)
    inputs[:, 1:] = targets[:, :-1]
    return inputs, targets


def test_lm_learns():
    rng = np.random.default_rng(6)
    stream = np.tile(rng.integers(0, 300, 8), 2000)
    model = lm.initial(np.bincount(stream, minlength=lm.VOCABULARY).astype(float))
    before, _ = lm.gradient(model, *_batch([stream[i : i + lm.WINDOW] for i in range(0, 640, 32)]))
    lm.descend(model, (_batch([stream[i : i + lm.WINDOW] for i in rng.integers(0, 9000, 16)]) for _ in range(80)), 0.01)
    after, _ = lm.gradient(model, *_batch([stream[i : i + lm.WINDOW] for i in range(0, 640, 32)]))
    assert after < before / 2


def test_lm_trains_on_every_token_after_its_predecessors(spark):
    """All tokens of long and short texts are targets once, with an end at real ends only."""
    stream = np.random.default_rng(5).integers(0, lm.END, 75)
    inputs, targets = lm._windows(np.concatenate([stream, [lm.END], [lm.END]]), np.array([0, 76, 77]))
    live = targets != lm.PAD
    assert targets[live].tolist() == [*stream, lm.END, lm.END]
    assert inputs[live].tolist() == [lm.END, *stream, lm.END]
    first = 2 * lm.STEP - (lm.WINDOW - lm.STEP) - 1
    assert inputs[2].tolist() == stream[first : first + lm.WINDOW].tolist()
    texts = [" ".join(f"word{i}" for i in range(700)), "one two", "", None]
    one = spark.createDataFrame([(t,) for t in texts], "_body string").coalesce(1)
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    wanted = len(lm.Subwords(tokenizer).encode([lm.words_of(t or "") for t in texts])[0])
    run = lm._training(tokenizer, lm.initial(np.ones(lm.VOCABULARY)), 0.01, 0)
    assert one.mapInArrow(run, "at int, weighted double, tokens bigint").first()["tokens"] == wanted > 1400


def test_pipeline(spark, folder, docs, rows):
    import corpus_pipeline as C

    here = docs
    for name, stage in C.STAGES[:-1]:
        there = spark.createDataFrame(stage(spark, here, folder).toArrow())
        assert there.columns == docs.columns, name
        ids, before = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in (there, here))
        assert ids <= before and (name == "lines") == (there.count() == here.count()), name
        here = there
    last = C.STAGES[-1][1](spark, here, folder)
    whole = C.run(spark, folder)
    assert sorted(map(tuple, last.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    assert 0.5 * len(rows) < last.count() < len(rows)
