"""The language model's work: texts are encoded once, softmaxes leave out places that no training text uses, both without a change of results."""

import zlib

import numpy as np
import pytest

from panelwright.llm import bpe, lm, runtime
from panelwright.llm.codec import encode_words
from panelwright.llm.queries import public_tokenizers


def test_lm_texts_reach_python_once(spark, docs, monkeypatch):
    made = []
    monkeypatch.setattr(lm, "map_arrow", lambda df, f, schema: [made.append(df.columns), runtime.map_arrow(df, f, schema)][1])
    scored = lm.score_texts(docs.limit(40), public_tokenizers.path("byte_bpe_50k.json"))
    assert scored.count() == 40
    assert sum("_body" in columns for columns in made) == 1 and len(made) == lm.ROUNDS + 3


@pytest.mark.parametrize("seen", [0, 5, 700, 2016, 2047, 2048])
def test_lm_unseen_subwords_share_a_place(seen):
    """They are alike, and all 2,048 probabilities still add up to one and begin at the smoothed unigram."""
    counts = np.zeros(lm.VOCABULARY)
    counts[np.random.default_rng(0).permutation(lm.VOCABULARY)[:seen]] = np.arange(1, seen + 1)
    model = lm.initial(counts)
    assert model.width == min(lm.MEMBERS, -(-seen // lm.CLASSES) + 1)
    w = lm.unpack(model.flat)
    for name in ("of_class", "of_member"):
        w[name][:] = 0
    every = np.arange(lm.VOCABULARY)[:, None]
    inputs = np.full((lm.VOCABULARY, lm.WINDOW), 7, np.int16)
    targets = np.concatenate([every, np.full((lm.VOCABULARY, lm.STEP - 1), lm.PAD)], axis=1).astype(np.int16)
    got = np.exp(lm.Scorer(model).windows(inputs, targets)[:, 0])
    assert got == pytest.approx((counts + 0.5) / (counts.sum() + 0.5 * lm.VOCABULARY), rel=1e-3)
    model.flat += np.random.default_rng(1).normal(0, 0.2, len(model.flat)).astype(np.float32)
    scores = lm.Scorer(model).windows(inputs, targets)[:, 0]
    assert np.exp(scores).sum() == pytest.approx(1, abs=1e-3)
    loss, _ = lm.gradient(model, inputs, np.concatenate([np.full((lm.VOCABULARY, lm.WINDOW - lm.STEP), lm.PAD), targets], axis=1))
    assert loss == pytest.approx(-scores.mean(), rel=1e-4)


def test_lm_gradient_with_padding_and_unseen_subwords():
    """Against differences, in double precision, with short texts whose windows have padding on both sides."""
    rng = np.random.default_rng(2)
    counts = np.where(np.arange(lm.VOCABULARY) < 300, rng.integers(1, 50, lm.VOCABULARY), 0).astype(float)
    model = lm.initial(counts)
    model.flat = model.flat.astype(np.float64) + rng.normal(0, 0.2, len(model.flat))
    inputs, targets = lm._windows(rng.integers(0, lm.VOCABULARY, 90), np.array([0, 3, 3, 60, 61, 90]))
    _, g = lm.gradient(model, inputs, targets)
    for at in [*rng.integers(0, len(model.flat), 6), *np.argsort(-np.abs(g))[:12]]:
        keep, step = model.flat[at], 1e-5
        model.flat[at] = keep + step
        up, _ = lm.gradient(model, inputs, targets)
        model.flat[at] = keep - step
        down, _ = lm.gradient(model, inputs, targets)
        model.flat[at] = keep
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=1e-3, abs=1e-6)


def test_lm_words_with_marks_are_encoded_as_by_the_pattern():
    rng, tokenizer = np.random.default_rng(3), public_tokenizers.path("byte_bpe_50k.json")
    words = sorted({bytes(rng.choice(list(b"abz.,;:!?'sTt09-"), rng.integers(1, 7)).tolist()) for _ in range(4000)} | {"été.".encode(), "日本,".encode(), b"don't.", b"the.", b"the"})
    ids, starts = lm.Subwords(tokenizer)._merged(words)
    want, offsets = encode_words(bpe.load_part(tokenizer, lm.MERGES), [" " + w.decode() for w in words])
    assert ids.tolist() == want.tolist() and starts.tolist() == offsets.tolist()


def test_lm_words_forgotten_are_encoded_alike():
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    documents = [lm.words_of(" ".join(f"word{i} plain, text." for i in range(k, k + 30))) for k in range(0, 200, 10)]
    whole, starts = lm.Subwords(tokenizer).encode(documents)
    short = lm.Subwords(tokenizer, most=40)
    parts = [short.encode([d])[0] for d in documents]
    assert np.concatenate(parts).tolist() == whole.tolist() and len(starts) == len(documents) + 1


def test_lm_empty_table_and_clashing_names(spark, empty, clashing):
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    assert lm.score_texts(empty, tokenizer).collect() == []
    names = clashing.withColumns({n: lm.F.lit("x") for n in ("ids", "turn", "held_out", "key", "rare", "count")})
    got = lm.score_texts(names, tokenizer).collect()
    assert sorted(r["doc_id"] for r in got) == [*range(6)] and all(r["n_tokens"] == 7 and r["score"] < 0 for r in got)
    nothing = spark.createDataFrame([(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1), "two words")], "doc_id long, text string")
    (row,) = lm.score_texts(nothing, tokenizer).collect()  # held out: nothing to learn from, nothing known
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (True, 3, 0, 0) and row["score"] < 0
