"""Sharding, quality rules, page text, pseudonyms: invariants and brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from chartweave.llm.mainpage import main_text, main_texts
from chartweave.llm.pseudonyms import KINDS, Feistel, Pseudonyms, luhn, with_pseudonyms
from chartweave.llm.quality import apply_rules, fit_rules, learn, text_statistics
from chartweave.llm.sharding import histogram_shards, op2_histogram_shards

SF = "/root/testdata/sf0.001"


def check_shards(out, shards, largest):
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    sizes = out.groupby("shard").shard_bytes.sum().reindex(range(shards), fill_value=0)
    assert sizes.max() - sizes.min() <= 2 * max(largest, 0.001 * sizes.mean()) + 1
    return sizes


def test_shards_are_near_equal(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 300), "s") for i in range(3000)] + [(i, "copy " * 30, "s") for i in range(3000, 4500)]
    out = histogram_shards(spark.createDataFrame(rows, "doc_id long, text string, Key__ string"), 24).toPandas()
    assert len(out) == 4500 and "Key__" in out
    check_shards(out, 24, 308)


def test_shards_odd_rows(spark):
    schema = "doc_id long, text string"
    assert histogram_shards(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None), (None, None), (1, "é"), (1, "é"), (2, ""), (3, "long " * 50000)]
    out = histogram_shards(spark.createDataFrame(rows, schema), 4).toPandas()
    assert len(out) == 6 and sorted(out.shard_bytes) == [8, 8, 8, 10, 10, 250008]
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_op2_digest(spark):
    out = op2_histogram_shards(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id").text
    assert (out.text_crc32 == [zlib.crc32((docs[i] or "").encode()) for i in out.doc_id]).all()
    assert (out["size"] == [len((docs[i] or "").encode()) + 8 for i in out.doc_id]).all()
    assert out.shard.nunique() == 24 and len(out) == len(docs)


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_statistics():
    rng = random.Random(2)
    texts = [None, "", " \n\t", "\x85a\xa0b\x1cc", "a\n\n b \na\n \x0b", "a b c d e " * 40]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "é日 ", "#%|", "　"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for t in texts:
        got = text_statistics(t)
        assert (got[:5] if got[0] else (0, 0, 0, 0, 0)) == (brute_statistics(t) if got[0] else (0, 0, 0, 0, 0)), t


def test_symbols_without_words_are_words():
    assert text_statistics("###")[:3] == (1, 3, 3)


def test_learned_rules_reach_held_out_rows():
    rng = np.random.default_rng(3)
    table = {"x": rng.random(3000), "y": rng.random(3000), "z": rng.random(3000)}
    bad = ((table["x"] > 0.8) & (table["y"] < 0.5)) | (table["z"] > 0.95)
    rules = learn({k: v[:2000] for k, v in table.items()}, bad[:2000])
    held = {k: v[2000:] for k, v in table.items()}
    said = np.zeros(1000, bool)
    for rule in rules:
        hit = np.ones(1000, bool)
        for c in rule:
            hit &= c.holds(held)
        said |= hit
    assert (said == bad[2000:]).mean() > 0.97
    assert learn({"x": np.zeros(0)}, np.zeros(0, bool)) == [] and learn(table, np.zeros(3000, bool)) == []


def test_quality_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = fit_rules(docs, labels)
    got = apply_rules(docs.withColumnRenamed("lang", "n_words_"), rules).join(labels, "doc_id").toPandas()
    judged = got[~got.base_failed]
    assert (judged.kept == (judged.quality == 1)).mean() > 0.97
    assert not got[got.base_failed].kept.any()
    few = spark.createDataFrame([(1, None), (2, ""), (3, "a b c d e f g h i j k"), (3, "a b c d e f g h i j k")], "doc_id long, text string")
    assert [r.kept for r in apply_rules(few, []).orderBy("doc_id").collect()] == [False, False, True, True]
    assert fit_rules(docs.limit(0), labels) == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header><a href=x>Home</a></header>
<nav><ul><li><a href="/">One</a><li>Two</ul></nav><div class="cookie-notice">We use cookies, all of them, always.</div>
<article><h1>Head &amp; line</h1><p>First <b>bold</b>
 text, with a <a href="#">link</a>.<p>Second&nbsp;para,<br>after a break. <script>x</script>And more of it, too.
<ul><li>A point, made here.</li><li>Another point, made there.</li></ul><div id="comments"><p>I like it, a lot, really.</p></div></article>
<aside>Side words, many of them, here.</aside><form><p>Search here</p></form><footer>&copy; us</footer></body></html>"""


def test_page_text():
    assert main_text(PAGE).split("\n\n") == [
        "Head & line", "First bold text, with a link.", "Second para, after a break. And more of it, too.", "A point, made here.", "Another point, made there.",
    ]
    assert main_text(None) == main_text("") == main_text("<p>") == main_text("<div class=ad>x</div>") == ""
    assert main_text("plain words, no markup") == "plain words, no markup"
    assert main_text("<p>cut off in a tag, here <a hre") == "cut off in a tag, here"
    links = "".join(f'<div><a href="/{i}">Item number {i}</a></div>' for i in range(30))
    assert main_text(f"<body><section>{links}</section><section><p>A long sentence, which says something, and goes on for a while.</p></section>") == (
        "A long sentence, which says something, and goes on for a while."
    )


def test_short_items_and_cells_of_an_article_stay():
    sentence = "A sentence of the article says something, at some length and to the end. "
    paragraphs = "".join(f"<p>{(sentence * 7)[:499]}{i}</p>" for i in range(5))
    items = [f"item number {i:03d}" for i in range(300)]
    kinds = {
        "list": ("<ul>", "<li>{}</li>", "</ul>"), "paragraphs in a list": ("<ul>", "<li><p>{}</p></li>", "</ul>"), "table": ("<table><tr>", "<td>{}</td>", "</tr></table>"),
        "terms": ("<dl>", "<dd>{}</dd>", "</dl>"), "links": ("<ul>", "<li><a href=x>{}</a></li>", "</ul>"),
    }
    for n in (10, 300):
        for name, (begin, item, end) in kinds.items():
            inner = begin + "".join(item.format(x) for x in items[:n]) + end
            got = main_text(f"<body><div><ul><li><a href=y>Start page</a></li></ul></div><article>{paragraphs}{inner}</article></body>").split("\n\n")
            assert len(got) == 5 + n and got[5:] == items[:n], (name, n)
    for tag in ("section", "div"):
        got = main_text(f"<body><{tag}>{paragraphs}<ul>" + "".join(f"<li>{x}</li>" for x in items[:10]) + f"</ul></{tag}></body>")
        assert got.split("\n\n")[5:] == items[:10]


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", None), (2, "u", "<p>é, a</p>"), (2, "u", "<p>é, a</p>"), (None, None, "<p>" + "x, " * 50000)], "page_id long, url string, html string")
    got = main_texts(df).collect()
    assert sorted((r.n_chars for r in got)) == [0, 4, 4, 149999]
    assert main_texts(df.limit(0)).columns == ["page_id", "url", "text", "n_chars"] and main_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(n):
    f = Feistel(b"k")
    got = [f.permuted("t", n, x) for x in range(n)]
    assert sorted(got) == list(range(n)) and [f.restored("t", n, x) for x in got] == list(range(n))


def test_pseudonyms():
    p = Pseudonyms(b"k")
    for kind, value in [
        ("card", "4111 1111 1111 1111"), ("card", "4111111111111111"), ("ip", "97.51.17.173"), ("email", "und.34@mail7.example.com"), ("phone", "+1 (017) 555-7713"),
        ("date", "2024-02-29"), ("date", "31.12.1999"), ("ssn", "123-45-6789"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"),
    ]:
        text, counts = p.text(f"see {value}, ok")
        assert counts[KINDS.index(kind)] == 1 == sum(counts) and value not in text and text.startswith("see ") and text.endswith(", ok")
        assert re.sub(r"[0-9a-zA-Z]", "", text) == re.sub(r"[0-9a-zA-Z]", "", f"see {value}, ok") or kind == "ip"
        assert p.text(text, back=True)[0] == f"see {value}, ok"
    a, b = (re.sub(r"\D", "", p.text(t)[0]) for t in ("4111 1111 1111 1111", "card 4111-1111-1111-1111."))
    assert a == b
    for decoy in ["4111 1111 1111 1112", "256.1.1.1", "2023-02-30", "000-12-3456", "version 2.0", "1234567", "GB00 WEST 1234 5698 7654 32"]:
        assert p.text(decoy) == (decoy, [0] * len(KINDS))


def test_values_before_more_digits_or_capitals():
    p = Pseudonyms(b"k")
    card, iban = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
    for value, kind, rest in ((card, "card", " 12/26"), (card, "card", " 123"), (card, "card", " 12 26"), (card.replace(" ", "-"), "card", " 12/26 x"), (card.replace(" ", ""), "card", " 123"), (iban, "iban", " BIC CAIXESBB"), (iban, "iban", " A1"), ("GB82 WEST 1234 5698 7654 32", "iban", " X")):
        new, counts = p.text(f"pay {value}{rest}")
        assert new.startswith("pay ") and new.endswith(rest) and value not in new and len(new) == len(value + rest) + 4
        assert counts[KINDS.index(kind)] == sum(counts) == 1
        assert p.text(new, back=True)[0] == f"pay {value}{rest}"
    rng = random.Random(45)
    for _ in range(300):
        own = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        said = f"{own}{luhn(own)} {rng.randrange(10, 100)}/28"
        assert p.text(p.text(said)[0], back=True)[0] == said
    two = f"{iban} a@b.example.com {card} 12/26"
    assert sum(p.text(two)[1]) == 3
    assert p.text("1234 5678 9012 3456 78")[0] == "1234 5678 9012 3456 78"


def test_pseudonym_table(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a@b.example.com", 0), (3, "a@b.example.com", 0)], "doc_id long, text string, N_card_ int")
    out = with_pseudonyms(df, b"k")
    got = out.collect()
    assert [r.n_email for r in got] == [0, 0, 1, 1] and got[0].text is None and got[2].text == got[3].text != "a@b.example.com"
    assert [r.text for r in with_pseudonyms(out.select(df.columns), b"k", back=True).collect()] == [None, "", "a@b.example.com", "a@b.example.com"]
    assert with_pseudonyms(df.limit(0), b"k").count() == 0
