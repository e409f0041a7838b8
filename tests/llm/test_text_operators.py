"""Per-row operators against plain versions: decontamination, token counts, encoding, quality, rules."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelwright.llm import bpe, codec, decontaminate, lexicon, quality_gam, quality_rules, queries, token_counts
from panelwright.llm.token_counts import Counter as Counting

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = st.text(st.sampled_from([*" \n\t\r\x0b\x1c\x85  'abtheslr123²Ⅷé日🙂!#_\x00"]), max_size=60) | st.text(max_size=40)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _windows(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [tuple(words[i : i + 13]) for i in range(max(1, len(words) - 12))] if words else []


def test_decontamination(spark, folder, rows):
    items = [(r["item_id"], _windows(r["text"])[1]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    owners = {}
    for item, windows in items:
        for w in windows:
            owners.setdefault(w, set()).add(item)
    lengths = {len(w) for w in owners}
    want = []
    for doc, text in rows:
        words, _ = _windows(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if ids := owners.get(tuple(words[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= ids
        want.append((doc, len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(words)))
    got = [tuple(r) for r in queries.op1_aho_corasick_decontamination(spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(w[2] for w in want)


def test_decontamination_offsets_and_edges(spark, docs, folder, clashing, empty):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(clashing, bench.limit(0)).where("contaminated or n_hit > 0").count() == 0
    twice = decontaminate.contamination(docs, bench.unionByName(bench)).select("doc_id", "n_hit", "items").collect()
    once = decontaminate.contamination(docs, bench).select("doc_id", "n_hit", "items").collect()
    assert sorted(map(tuple, once), key=repr) == sorted(map(tuple, twice), key=repr)
    machine = decontaminate.build_automaton([(7, "Größe ZWEI drei"), (8, "drei"), (9, None), (10, " - ")])
    bodies = ["", "é-größe, zwei\tDREI! Vier drei", "größe", "zwei drei"]
    found = machine.scan(bodies)
    assert (found.first.tolist(), found.hit.tolist()) == ([0, 0, 6, 7, 9], [False, True, True, True, False, True, False, False, True])
    assert [sorted(x) for x in found.items] == [[], ["7", "8"], [], ["8"]]
    assert [[body[a:b] for a, b in found.spans(i)] for i, body in enumerate(bodies)] == [[], ["größe, zwei\tDREI", "drei"], [], ["drei"]]


SMALL = st.lists(st.sampled_from("abc"), max_size=40).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(SMALL, max_size=6), st.lists(SMALL, max_size=5))
def test_automaton_finds_what_all_windows_find(items, bodies):
    found = decontaminate.build_automaton(enumerate(items)).scan(bodies)
    for i, body in enumerate(bodies):
        words, hit, owners = body.split(), set(), set()
        for item, text in enumerate(items):
            for window in _windows(text)[1]:
                for at in range(len(words) - len(window) + 1):
                    if tuple(words[at : at + len(window)]) == window:
                        hit.update(range(at, at + len(window)))
                        owners.add(str(item))
        assert np.flatnonzero(found.hit[found.first[i] : found.first[i + 1]]).tolist() == sorted(hit)
        assert sorted(found.items[i]) == sorted(owners)


def test_automaton_of_a_large_benchmark_is_read_from_its_file(tmp_path):
    """Two megabytes of random words: a node takes 16 bytes, and the arrays stay in the file."""
    rng = np.random.default_rng(5)
    drawn = [f"w{i}" for i in rng.integers(0, 300_000, 300_000)]
    items = [(i, " ".join(drawn[i * 100 : i * 100 + 100])) for i in range(3000)]
    with open(tmp_path / "machine.arrow", "wb") as out:
        decontaminate.build_automaton(items).write(out)
    assert (tmp_path / "machine.arrow").stat().st_size < 250 * len(drawn)
    before = pa.total_allocated_bytes()
    machine = decontaminate.Automaton.open(str(tmp_path / "machine.arrow"))
    assert pa.total_allocated_bytes() - before < 1 << 16
    found = machine.scan([text for _, text in items[:50]] + [" ".join(drawn[50:150])])
    assert found.hit.all()
    assert found.items[:50] == [[str(i)] for i in range(50)]
    assert sorted(found.items[50]) == ["0", "1"]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_tokens_of_any_text(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert Counting(PATH).count([text, f"{text}<|endoftext|>{text}"]) == [len(ids), 2 * len(ids) + 1]
    found, starts = codec.encode_words(bpe.load(PATH), ["".join(bpe.PATTERN.findall(text))])
    assert found[: starts[1]].tolist() == ids


def test_pretokens_cover_every_code_point():
    texts = [f"a{c}1{c} {c}b" for c in map(chr, range(0x3000)) if not 0xD800 <= ord(c) < 0xE000]
    assert Counting(PATH).count(texts) == [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_and_round_trip(spark, folder, rows, clashing, empty):
    encoded = LIBRARY.encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    counts = sorted(((d, len((t or "").encode()), len(e.ids), len(e.ids) > 512) for (d, t), e in zip(rows, encoded, strict=True)), key=repr)
    assert sorted(map(tuple, queries.op2_rank_synchronous_token_counts(spark, folder).collect()), key=repr) == counts
    want = sorted(((d, len(e.ids), sha(",".join(map(str, e.ids))), sha(LIBRARY.decode(e.ids, skip_special_tokens=False))) for (d, _), e in zip(rows, encoded, strict=True)), key=repr)
    assert sorted(map(tuple, queries.op5_transducer_lexicon_bpe(spark, folder).collect()), key=repr) == want
    assert token_counts.count_tokens(empty, PATH).count() == 0 and codec.round_trip(empty, PATH).count() == 0
    back = codec.decode(codec.encode(clashing, PATH), PATH).collect()
    assert all(r["decoded"] == r["text"] for r in back) and all(r["word"] == "x" for r in back)


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 9), min_size=1, max_size=3), max_size=30), st.lists(st.binary(max_size=6), max_size=10))
def test_lexicon_finds_its_words_alone(tmp_path_factory, words, others):
    path = tmp_path_factory.mktemp("lexicon") / "l.bin"
    path.write_bytes(lexicon.compile_lexicon(words))
    found = lexicon.Lexicon(str(path))
    asked = [*words, *others]
    for word, number in zip(asked, found.find(asked), strict=True):
        assert (number >= 0) == (word in words)
        if number >= 0:
            assert found.ids[found.offsets[number] : found.offsets[number + 1]].tolist() == words[word]


def _auc(scores, labels):
    order = np.argsort(np.argsort(scores)) + 1
    ones = labels.sum()
    return (order[labels == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(labels) - ones))


def _held_out(spark, name, column):
    """Scores and labels of fold 0 at a size with enough labels."""
    sf = "/root/testdata/sf0.01"
    found = getattr(queries, name)(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = found[[zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]]
    return held, _auc(held[column].to_numpy(), held.quality.to_numpy())


def test_quality_model_holds_out_of_sample(spark):
    held, auc = _held_out(spark, "op7_pairwise_gam_quality", "score")
    assert held.held_out.all() and auc > 0.97
    assert ((held.score >= 0.3).astype(int) == held.predicted).all() and held[held.quality == 1].predicted.mean() > 0.97


def test_quality_model_edges(spark, docs, folder, clashing, empty):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = queries.op7_pairwise_gam_quality(spark, folder).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    flat = quality_gam.train(docs, labels.limit(0))
    assert {r["score"] for r in quality_gam.score_quality(clashing, flat).collect()} == {0.5}
    assert quality_gam.score_quality(empty, flat).count() == 0
    torn = labels.unionByName(labels.selectExpr("doc_id", "1 - quality AS quality", "toxic"))
    assert quality_gam.labelled(docs, torn, "text", 1000).count() == 0
    # Labels without a document take no place under the bound, and an id that repeats is one row.
    strangers = labels.unionByName(labels.selectExpr("doc_id + 5000000 AS doc_id", "quality", "toxic"))
    known = quality_gam.labelled(docs, labels, "text", 1000)
    twice = quality_gam.labelled(docs.unionByName(docs), strangers, "text", known.count())
    assert known.count() > 20 and sorted(map(tuple, twice.collect())) == sorted(map(tuple, known.collect()))


def test_pair_tables_learn_what_single_ones_cannot():
    rng = np.random.default_rng(1)
    x = np.zeros((2000, len(quality_gam.FEATURES)))
    x[:, 3:5] = rng.uniform(-1, 1, (2000, 2))
    y = (x[:, 3] * x[:, 4] > 0).astype(float)
    model = quality_gam.fit(x, y)
    assert (3, 4) in model.pairs and _auc(model.score(x), y) > 0.95


def _statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    held = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {j for i in range(len(words) - 4) if held[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_rules_count_exactly(spark, folder, rows):
    got = sorted((tuple(r[:7]) for r in queries.op10_hashed_ngram_quality_rules(spark, folder).select("doc_id", *quality_rules.COUNTS, "base_failed").collect()), key=repr)
    want = []
    for doc, text in rows:
        s = _statistics(text or "")
        want.append((doc, *s, s[0] < 10 or 100 * s[4] > 20 * s[0]))
    assert got == sorted(want, key=repr)


def test_rules_hold_out_of_sample(spark, clashing, empty):
    held, auc = _held_out(spark, "op10_hashed_ngram_quality_rules", "probability")
    assert auc > 0.9 and held[(held.quality == 1) & ~held.base_failed].kept.mean() > 0.95
    flat = quality_rules.fit(np.zeros((0, 3 * quality_rules.BUCKETS)), np.zeros(0), np.zeros(0, bool))
    assert quality_rules.apply_rules(empty, flat).count() == 0
    assert {r["probability"] for r in quality_rules.apply_rules(clashing, flat).collect()} == {0.5}


@pytest.mark.parametrize("text", ["", " ", "a", "ab", "\n\n", "é"])
def test_short_texts_have_features(text):
    assert len(quality_gam.features(text)) == len(quality_gam.FEATURES) and np.isfinite(quality_rules.hashed(text)).all()
