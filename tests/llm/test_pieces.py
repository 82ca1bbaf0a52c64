"""Piece encoding and decoding against the sentencepiece library."""

import hashlib
import random
import time

import pytest
import sentencepiece

from lodestream.llm import pieces


@pytest.fixture(scope="module")
def both():
    path = pieces.default_pieces()
    return pieces.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)


def made(rng, library):
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ab ", "aA▁ \n\t0189", "the ation er in on", "éüß语言日本のсло ва", "ａ😀́\x00"]
    kind = rng.randrange(3)
    if kind == 0:
        return "".join(library.id_to_piece(rng.randrange(259, 32000)).replace("▁", " ") for _ in range(rng.randint(0, 12)))
    one = rng.choice(alphabets)
    return "".join(rng.choice(rng.choice(alphabets) if kind == 1 else one) for _ in range(rng.randint(0, 120)))


def test_equals_the_library(both):
    model, library = both
    rng = random.Random(3)
    for _ in range(4000):
        text = made(rng, library)
        ids = library.encode(text)
        assert model.encode(text) == ids, repr(text)
        assert model.decode(ids) == library.decode(ids), repr(text)
        any_ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(270) for _ in range(rng.randint(0, 8))]
        assert model.decode(any_ids) == library.decode(any_ids), any_ids


def test_words_merge_the_same_together_and_alone(both):
    model, library = both
    rng = random.Random(4)
    texts = [made(rng, library) for _ in range(500)]
    ids, cuts = model.ids_of([u for t in texts for u in [[w for units in model.units(t) for w in units]]])
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == [library.encode(t) for t in texts]


def test_very_long_words_and_spaces(both):
    model, library = both
    rng = random.Random(5)
    start = time.time()
    for text in ("a" * 100_000, "abc" * 30_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000)), " " * 100_000, "语" * 50_000, "ab" + " " * 50_000 + "x", "1 " * 100_000):
        assert model.encode(text) == library.encode(text)
    assert time.time() - start < 30


def test_digests_of_documents(spark, both, monkeypatch):
    _, library = both
    monkeypatch.setattr(pieces, "CHUNK", 1000)  # long texts go in parts
    texts = [None, "", " ", "  a  b ", "Same text", "Same text", "x" * 5000, "word  two " * 3000, "日本 café\n"]
    rows = spark.createDataFrame([(None if i == 4 else i, t, "clash", 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, ids int")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encode_digests(rows).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {(None if i == 4 else i, len(e := library.encode(t or "")), sha(",".join(map(str, e))), sha(library.decode(e))) for i, t in enumerate(texts)}
    assert got == want
    assert pieces.encode_digests(rows.limit(0)).count() == 0


def test_columns_of_ids_and_back(spark):
    rows = spark.createDataFrame([(1, "a text  here"), (2, None)], "ids int, text string")
    there = pieces.encode_pieces(rows, ids_col="codes")
    back = {r.ids: r.decoded for r in pieces.decode_pieces(there, ids_col="codes").collect()}
    assert back == {1: "a text  here", 2: ""}


def test_another_kind_of_model_is_refused():
    with pytest.raises(Exception):  # noqa: B017
        pieces.PieceModel("/nonexistent.model")


def test_words_beyond_the_bound_are_learnt_anew():
    path = pieces.default_pieces()
    small, library = pieces.PieceModel(path, cache_words=3), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in ("one two three four five", "six seven one", "two  eight nine"):
        assert small.encode(text) == library.encode(text)
