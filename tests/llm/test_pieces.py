"""SentencePiece encoding, spans, normalising and decoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ENCODER = pieces.Encoder(PATH)
TEXTS = st.text(st.sampled_from([*" \n\t▁ab  theingé日本🙂\x00<s>.'1\xa0ﬁｶﾞ①²"]), max_size=60) | st.text(max_size=40)


def same(library, encoder, path, batch):
    ids, at = encoder.encode(batch)
    begin, end = encoder.spans(batch, ids, at)
    decoded = pieces.decode_ids(path, ids, at)
    for i, text in enumerate(batch):
        mine = slice(at[i], at[i + 1])
        assert ids[mine].tolist() == library.encode(text), text
        assert decoded[i] == library.decode(library.encode(text)), text
        want = library.encode(text, return_type="proto").pieces
        assert [*zip(begin[mine].tolist(), end[mine].tolist(), strict=True)] == [(p.begin, p.end) for p in want], text


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_any_texts(batch):
    same(LIBRARY, ENCODER, PATH, batch)


def test_long_runs_blanks_and_characters():
    draw = random.Random(2)
    letters = "".join(draw.choice("abtheingsrlo") for _ in range(3000))
    points = [chr(c) for c in [*range(0, 0xD800, 23), *range(0xE000, 0x11000, 97)]]
    same(LIBRARY, ENCODER, PATH, ["", " ", "  ", " a", "a ", "▁▁a", "a▁b", "a" * 500, "aaab" * 200 + " " + "ab" * 400, " " * 77 + "x", "x" + " " * 130, letters, *points])


def test_decoding_of_any_ids():
    draw = random.Random(4)
    rows = [[draw.randrange(32_000) if draw.random() < 0.5 else draw.randrange(262) for _ in range(draw.randint(0, 12))] for _ in range(1500)]
    decoded = pieces.decode_ids(PATH, np.array([i for r in rows for i in r], np.int64), np.concatenate([[0], np.cumsum([*map(len, rows)])]))
    assert decoded == [LIBRARY.decode(r) for r in rows]


@pytest.fixture(scope="module", params=["nmt_nfkc", "nfkc_cf"])
def mapped(request, tmp_path_factory):
    """The model with a compiled character map put in (its later fields replace its own), and blanks squeezed."""
    spec = dict(pieces.fields(sentencepiece.SentencePieceNormalizer(rule_name=request.param).serialized_model_proto()))[3]
    size, varint = len(spec), b""
    while size >= 128:
        varint, size = varint + bytes([size & 127 | 128]), size >> 7
    path = tmp_path_factory.mktemp("model") / f"{request.param}.model"
    with open(PATH, "rb") as f:
        path.write_bytes(f.read() + b"\x1a" + varint + bytes([size]) + spec)
    return str(path)


def test_character_map(mapped):
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=mapped), pieces.Encoder(mapped)
    assert not encoder.model.normalizer.plain and encoder.model.normalizer.map.units
    draw = random.Random(8)
    alphabet = [*"  \n\t▁abTHEé日ﬁｶﾞ①²\xa0Å№ßİ́Ⅷ…ｱﾊﾟ🙂​　㎏", "ing ", "  "]
    batch = ["", " ", "   ", "ﬁ", " ﬁ ① ", *("".join(draw.choice(alphabet) for _ in range(draw.randint(1, 30))) for _ in range(400))]
    for text in batch:
        normal, begins = encoder.model.normalizer.normalize(text)
        assert normal == library.normalize(text).replace(" ", pieces.BLANK) and len(begins) == len(normal) + 1
    same(library, encoder, mapped, batch)


def test_query(spark, folder, rows):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = []
    for doc, text in rows:
        ids = LIBRARY.encode(text or "")
        want.append((doc, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)), len((text or "").encode())))
    got = queries.op12_aligned_sentencepiece(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_spanned"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_edges(spark, docs, clashing, empty):
    done = pieces.encode(clashing, PATH)
    assert {*done.columns} == {*clashing.columns, "begins", "ends"}
    back = pieces.decode(done, PATH)
    assert all(r["decoded"] == r["text"] and r["score"] == "x" for r in back.collect())
    assert pieces.encode(empty, PATH, back=True).count() == pieces.decode(pieces.encode(empty, PATH), PATH).count() == 0
    for r in pieces.encode(docs.limit(50), PATH, keep=["text"]).collect():
        data = (r["text"] or "").encode()
        assert b"".join(data[a:b] for a, b in zip(r["begins"], r["ends"], strict=True)) == data
