"""Files of id blocks, filter audits, phrases: against brute force and the libraries."""

import io
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from chartweave.llm.idfiles import BLOCK, BlockFile, BlockWriter, IdBlocks, encoded, manifest, packed, packed_blocks, read_ids, unpacked, unpacked_blocks, write_ids

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_numbers_of_any_width():
    rng = np.random.default_rng(1)
    for width in range(33):
        values = rng.integers(0, 1 << width, (3, BLOCK)).astype("<u4")
        raw = packed(values, width)
        assert raw.shape == (3, 128 * width) and (unpacked(raw, width) == values).all()


def test_blocks_with_exceptions():
    rng = np.random.default_rng(2)
    for most in (1, 2, 100, 1 << 16, 1 << 32):
        for percentile in (0.0, 0.5, 0.98, 1.0):
            ids = np.where(rng.random(4 * BLOCK) < 0.9, rng.integers(0, max(1, most // 60), 4 * BLOCK), rng.integers(0, most, 4 * BLOCK)).astype("<u4")
            blocks = packed_blocks(ids, percentile)
            starts = np.cumsum([0, *map(len, blocks)])
            assert (unpacked_blocks(b"".join(blocks), starts) == ids).all()
            one = starts[2:4]  # a block by itself
            assert (unpacked_blocks(b"".join(blocks)[one[0] : one[1]], one - one[0]) == ids[2 * BLOCK : 3 * BLOCK]).all()


@pytest.mark.parametrize("lengths", [[], [0], [0, 0, 3], [5, 0, 3000, 0, 1024, 1, 700_000, 0], [1024] * 3])
def test_files_by_documents(lengths):
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 50_000, n).astype("<u4") for n in lengths]
    out = io.BytesIO()
    writer = BlockWriter(out, 0.98)
    for k, ids in enumerate(docs):
        writer.add(None if k == 1 else k - 1, ids)
    writer.close()
    back = BlockFile(pa.BufferReader(out.getvalue()))
    assert back.n_ids == sum(lengths) and back.null.tolist() == [k == 1 for k in range(len(docs))]
    begin = 0
    for ids, end in zip(docs, back.ends.tolist(), strict=True):
        assert (back.ids(begin, end) == ids).all()
        begin = end
    with pytest.raises(ValueError):
        BlockFile(pa.BufferReader(out.getvalue()[:-1] + b"x"))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def expected(rows, tokenizer):
    """Rows (id, text) with any order within an id, as {(id, start, n, crc)}."""
    out, at = [], 0
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_ids_in_order_and_back(spark, tokenizer, tmp_path):
    rows = [(7, "b c", "x"), (3, None, "y"), (12, "", "z"), (-4, "the " * 40_000, "w"), (2**40, "a<|endoftext|>b", "v"), (5, "é 日本\n\n  x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    folder = f"file://{tmp_path}/ids"
    write_ids(df.repartition(3), folder, BPE, end_id=2)
    back = read_ids(spark, folder).collect()
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in back]
    assert sorted(got) == expected(sorted((r[:2] for r in rows), key=lambda r: r[0]), tokenizer)
    # small segments meet in the same documents, and a second writing replaces the first
    spark.dataSource.register(IdBlocks)
    small = spark.read.format("idblocks").option("segment", 1000).load(folder).collect()
    assert sorted(small) == sorted(back)
    write_ids(df.where("doc_id > 6"), folder, BPE, end_id=2)
    assert read_ids(spark, folder).count() == 3 and len(list((tmp_path / "ids").glob("*.idblocks"))) == len(manifest(folder))
    assert encoded(df, BPE).columns == ["doc_id", "ids", "ids_"]


def test_repeated_null_and_no_rows(spark, tokenizer, tmp_path):
    rows = [(None, "b"), (None, "a"), (1, "x y"), (1, "x y"), (1, "z"), (0, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    write_ids(df, str(tmp_path / "ids"), BPE)
    back = sorted(read_ids(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in back] == [None, None, 0, 1, 1, 1]
    assert [r.start for r in back] == np.cumsum([0, *(r.n_tokens for r in back[:-1])]).tolist()
    assert sorted(tokenizer.decode(np.frombuffer(r.ids, "<u4").tolist()) for r in back) == sorted(t for _, t in rows)
    write_ids(df.limit(0), str(tmp_path / "none"), BPE)
    assert read_ids(spark, str(tmp_path / "none")).count() == 0


def test_many_documents_as_the_library(spark, tokenizer):
    import duckdb
    from chartweave.llm.idfiles import op13_patched_blocks

    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()
    got = [tuple(r) for r in op13_patched_blocks(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == expected(rows, tokenizer)


# ---- filter audit


def brute_audit(docs, labels):
    """Every order applied document by document."""
    import re
    from collections import defaultdict
    from itertools import permutations

    said = defaultdict(lambda: [0, 0])
    for i, quality, toxic in labels:
        if i is not None:
            said[i] = [max(said[i][0], int(quality == 1)), max(said[i][1], int(toxic == 1))]
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        rows.append((source or "", {x for x in fails if fails[x]}, *(said[i] if i is not None else (0, 0))))
    out = {}
    for part in {r[0] for r in rows}:
        of, shapley = [r for r in rows if r[0] == part], defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = of
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                failing = [r for r in of if x in r[1]]
                shapley[x] += len(gone)
                out[part, order, step] = (len(left), len(gone), len(failing) - len(gone), sum(r[1] == {x} for r in of), sum(r[2] for r in gone), sum(r[3] for r in gone))
        for key in [k for k in out if k[0] == part]:
            out[key] += (shapley[key[1][key[2] - 1]],)
    return out


def test_audit_equals_every_order(spark):
    import random
    from chartweave.llm.audit import COUNTS, filter_audit

    rng = random.Random(5)
    long = " ".join(f"word{k}" for k in range(60))
    texts = [None, "", "  \t", long, long + " $", long.upper(), "the " * 80, "THE # " * 60, "a b", "é\x0bx\x0cy " * 30, long + " and\xa0so", "| " * 3 + long]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["x", "x", "x", "", None, "y"])) for _ in range(150)]
    docs += [(3, long, "x")] * 3 + [(100, long, "zero"), (1000 + 1, " ".join(f"w{k}" for k in range(50)), "clean")]
    labels = [(rng.choice([None, *range(45)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(60)]
    df = spark.createDataFrame([(*d, 1, "n") for d in docs], "doc_id long, text string, source string, part int, fails string")
    said = spark.createDataFrame(labels, "doc_id long, quality long, toxic long")
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in filter_audit(df, said).collect()}
    want = brute_audit(docs, labels)
    assert got == want and len(got) == 600 * len({s or "" for _, _, s in docs})
    assert all(got["clean", o, 1][1] == 0 for _, o, _ in got if _ == "clean")
    assert filter_audit(df.limit(0), said).count() == 0
    assert {tuple(r) for r in filter_audit(df, said.limit(0)).select("good_lost", "toxic_lost").collect()} == {(0, 0)}


def test_removals_name_the_first_filter(spark):
    from chartweave.llm.audit import failing_parts, removals

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c"), (None, "d"), (4, "e")], "id long, removed_by string")
    failing = {x: spark.createDataFrame([(i,) for i in ids], "id long") for x, ids in {"A": [1, 3, 3], "B": [3, 2, None], "C": [9]}.items()}
    by = lambda order: sorted((r.id or 0, r.removed_by_) for r in removals(rows, failing, order, ["id"]).collect())
    assert by("ABC") == [(0, None), (1, "A"), (2, "B"), (3, "A"), (3, "A"), (4, None)]
    assert by("CBA") == [(0, None), (1, "A"), (2, "B"), (3, "B"), (3, "B"), (4, None)]
    parts = failing_parts(rows, failing, ["id"])
    assert sorted((r.id, r.fails) for r in parts.collect()) == [(1, 1), (2, 2), (3, 3), (3, 3)]


# ---- phrases


def brute_phrases(docs, least=10, percent=50, top=2000):
    import re
    from collections import Counter, defaultdict

    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in (1, 2, 3):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        found = []
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            if any(100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items() if len(q) > len(p)):
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrase_documents():
    import random

    rng = random.Random(6)
    words = ["the", "the", "of", "A", "Été", "straße", "\x00", "\xa0", "x|y", "İ", "q"]
    docs = []
    for _ in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", "\r\n", "! "]) for _ in range(rng.randint(0, 40)))
        docs.append((text, rng.choice(["en", "en", "und", None, "de", ""])))
    return docs + [(None, "en"), ("", None), ("the of " * 500, "en"), ("a B c d, " * 12, "fr"), ("a b e " * 3, "fr"), ("one two", "it")] + [("same old words here", "en")] * 15


@pytest.mark.parametrize(("at_once", "sample", "top"), [(2_000_000, 0.02, 2000), (60, 1.0, 2000), (7, 1.0, 9)])
def test_phrases_equal_brute_force(spark, at_once, sample, top):
    from chartweave.llm.phrases import collocations, common_prefixes

    docs = phrase_documents()
    df = spark.createDataFrame([(*d, 1, "x", "y") for d in docs], "text string, lang string, rank int, prefix string, key string")
    if sample == 1.0:
        assert common_prefixes(df, 1.0, at_once)[("en", "the")] > 1
    got = collocations(df.repartition(3), at_once=at_once, sample=sample, top=top, bits=64 if at_once == 60 else 1 << 20)
    assert sorted(map(tuple, got.collect())) == brute_phrases(docs, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_phrases_of_nothing_and_large_counts(spark):
    from chartweave.llm.phrases import collocations, exact_score
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")
    assert collocations(df).count() == 0 and collocations(df.limit(0)).count() == 0
    rows = [(10**15 + 7, 10**15 + 9, 3 * 10**15 + 1), (10, 10, 10), (3, 7, 11), (2**40, 2**50, 2**41)]
    table = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", exact_score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert all(r.s == 10**6 * r.a**2 // (r.l * r.r) for r in table.collect())


def test_a_long_text_in_parts(spark):
    from chartweave.llm.common import STRETCH
    from chartweave.llm.phrases import collocations

    docs = [("north star shines " * (STRETCH // 9), "en"), ("x" * (STRETCH + 5) + " tail end", "en")]
    df = spark.createDataFrame(docs, "text string, lang string")
    assert sorted(map(tuple, collocations(df, at_once=100_000).collect())) == brute_phrases(docs)
