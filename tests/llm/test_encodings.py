"""Pieces, tokens, packing: against the libraries and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from chartweave.llm.packing import best_plan, pack, plan, token_pieces
from chartweave.llm.pieces import codec, decode_ids, encode_texts, piece_digests, utf8
from chartweave.llm.tokens import StretchEncoder, WholeTextEncoder, merge_ranks, joined, line_starts, section_token_counts, section_tokens, token_starts, with_ids

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a b ", "a\nb", "▁x", "日本\t\x00", "<s>", "<0x41>é ﬁ", "😀😀", "́x", " " * 70 + "a", "a" * 500, "ab" * 300, "the" * 100, "\x01 ⁇", "Is and on the of.\n\nThe 12 \x1c\xa0 it's"]


def random_texts(n, seed):
    rng = random.Random(seed)
    letters = list("abcdeghinorst  ▁\n.,!éß日1230😀\x00\t'")
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t


def test_pieces_equal_the_library(library):
    c = codec(PIECES)
    for t in ODD + random_texts(1500, 1):
        ids = library.encode(t)
        assert c.encode(t) == ids
        assert c.decode(ids) == library.decode(ids)
        assert c.digest(t) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_backtracking_equals_merging():
    c = codec(PIECES)
    rng = random.Random(2)
    pieces = [p for p in c.id_of if len(p) > 1]
    for _ in range(800):
        text = "".join(rng.choice(pieces) for _ in range(3))
        assert c.backtrack(text) == c.merged(text)


def test_decoding_any_ids(library):
    c = codec(PIECES)
    rng = random.Random(3)
    for _ in range(800):
        ids = [rng.randrange(3, 259) if rng.random() < 0.5 else rng.randrange(32000) for _ in range(rng.randint(0, 8))]
        assert c.decode(ids) == library.decode(ids)
    assert utf8(b"\xe6\x97a\xff") == "��a�"


def test_piece_tables(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (3, "a b", "z"), (None, "the " * 30000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_ string")
    out = piece_digests(df, PIECES)
    assert out.columns == ["doc_id", "text", "ids_", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = {r["ids_"]: r for r in out.collect()}
    assert got["x"].n_tokens == 0 and got["x"].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert got["w"].n_tokens == len(library.encode("the " * 30000))
    back = decode_ids(encode_texts(df, PIECES), PIECES).collect()
    assert all(r.decoded == (r.text or "") for r in back) and len(back) == 5
    assert piece_digests(df.limit(0), PIECES).count() == 0


def test_stretches_equal_whole_texts(tokenizer):
    texts = ODD + random_texts(2000, 4) + ["a <|endoftext|> b"]
    ids, starts = StretchEncoder(BPE), StretchEncoder(BPE, offsets=True)
    for t, x, y in zip(texts, ids(texts), starts(texts), strict=True):
        e = tokenizer.encode(t, add_special_tokens=False)
        assert joined(x[1]).tolist() == e.ids
        assert token_starts(*y).tolist() == [o[0] for o in e.offsets]


def test_whole_texts_equal_the_library(tokenizer):
    texts = ODD + random_texts(2000, 8) + ["a <|endoftext|> b", "x" * 20000, " " * 20000, "\n" * 5000 + "é" * 5000]
    fast, cautious = WholeTextEncoder(BPE), WholeTextEncoder(BPE, longest=10)
    for t in texts:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert fast(t).tolist() == ids and cautious(t).tolist() == ids
    ranks = merge_ranks(BPE)
    assert len(ranks) == 50256 and ranks[b" the"] == tokenizer.token_to_id("Ġthe")


def test_added_tokens_equal_the_untouched_library(spark):
    from tokenizers import Tokenizer

    untouched = Tokenizer.from_file(BPE)
    rng = random.Random(9)
    some = ["<|endoftext|>", " ", "  ", "\n", "\n ", "a", "the", " b", "é", "<|", "|>", "\t", "\xa0"]
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x  <|endoftext|>", " <|endoftext|> b"] + ["".join(rng.choice(some) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    fast, cautious = WholeTextEncoder(BPE, added=True), WholeTextEncoder(BPE, longest=0, added=True)
    starts = StretchEncoder(BPE, offsets=True, added=True)
    for t, y in zip(texts, starts(texts), strict=True):
        e = untouched.encode(t, add_special_tokens=False)
        assert fast(t).tolist() == cautious(t).tolist() == e.ids
        assert token_starts(*y).tolist() == [o[0] for o in e.offsets]
    assert fast("a<|endoftext|>b").tolist() == [64, 50256, 65]
    df = spark.createDataFrame(list(enumerate(texts[:300])), "doc_id long, text string")
    assert {r.doc_id: r.ids for r in with_ids(df, BPE).collect()} == {i: untouched.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts[:300])}
    pieces = {r.doc_id: r for r in token_pieces(df, BPE, 512).collect()}
    counts = {r.doc_id: r.text_tokens for r in section_token_counts(df, BPE).collect()}
    for i, t in enumerate(texts[:300]):
        ids = untouched.encode(t, add_special_tokens=False).ids
        assert counts[i] == len(ids)
        assert pieces[i].ids_crc32 == zlib.crc32(np.array([*ids, 0], "<u4").tobytes())


def test_section_counts(spark, tokenizer):
    texts = [None, "", "\n", "one line", "two\nlines\n", "a\n\n\nb é日\n x"] + random_texts(60, 5)
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, Section_ long")
    got = section_token_counts(df, BPE).toPandas()
    for i, t in enumerate(texts):
        mine = got[got.doc_id == i].sort_values("section")
        begins = line_starts(t or "")
        e = tokenizer.encode(t or "", add_special_tokens=False)
        assert mine.n_tokens.tolist() == section_tokens(np.array([o[0] for o in e.offsets], np.int64), begins).tolist()
        assert mine.n_tokens.sum() == len(e.ids) == mine.text_tokens.iloc[0]
        assert mine.start.tolist() == begins.tolist() and mine.end.iloc[-1] == len(t or "")
    assert section_token_counts(df.limit(0), BPE).count() == 0


def test_plans_hold_every_length():
    rng = random.Random(6)
    for _ in range(150):
        capacity = rng.choice([10, 50, 200])
        counts = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(0, 20))}
        for runs in (plan(counts, capacity, groups=rng.choice([2, 5, 24])), best_plan(counts, capacity)):
            got = {}
            for n, inside in runs:
                assert n > 0 and sum(a * b for a, b in inside) <= capacity
                for a, b in inside:
                    got[a] = got.get(a, 0) + n * b
            assert got == counts


def test_packing(spark, tokenizer):
    rng = random.Random(7)
    texts = [None, "", "the " * 5000] + [" ".join(rng.choice(["ab", "the", "x1"]) for _ in range(rng.randint(0, 900))) for _ in range(150)] + ["same text"] * 40
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(7, texts[7], "k")], "doc_id long, text string, len__ string")
    pieces = token_pieces(df, BPE, 512).cache()
    out = pack(pieces.drop("len__"), 512).toPandas()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    assert out.length.sum() == sum(map(len, ids.values())) + len(ids[7])
    for r in out.itertuples():
        assert list(r.ids) == ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 512
    assert out[out.piece > 0].length.eq(512).all()
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 512) + 1
    assert pack(pieces.limit(0), 512).count() == 0


def test_ids(spark, tokenizer):
    df = spark.createDataFrame([(1, "a  b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in with_ids(df, BPE).collect()}
    assert got == {1: tokenizer.encode("a  b").ids, 2: []}
