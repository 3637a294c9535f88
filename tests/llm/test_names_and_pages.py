"""Clashing column names, page scores by brute force, dates as permutations, and the pipeline as a whole."""

import datetime
import random
import time
from html.parser import HTMLParser

import corpus_pipeline
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from chartweave.llm import mainpage
from chartweave.llm.mainpage import blocks, main_text, main_texts, scores
from chartweave.llm.neardup import one_of_each, op1_bag_minhash
from chartweave.llm.packing import pack, packed_sequences, token_pieces
from chartweave.llm.passages import passage_stage, repeated_passages
from chartweave.llm.pieces import decode_ids, encode_texts, piece_digests
from chartweave.llm.pseudonyms import DEMONSTRATION_KEY, Pseudonyms, op10_feistel_pseudonyms, pseudonym_stage, run_key, session_key, with_pseudonyms
from chartweave.llm.quality import apply_rules
from chartweave.llm.tokens import WholeTextEncoder, section_token_counts, with_ids
from chartweave.llm.vectors import linked_vectors

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


def test_new_columns_never_clash(spark):
    def frame(*names):
        return spark.createDataFrame([(1, "a@b.example.com is one of ten words in this short text", *("old" for _ in names))], ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))

    cases = [
        (lambda df: with_pseudonyms(df, b"k"), ["n_email", "N_card", "replaced__"]), (lambda df: pseudonym_stage(spark, df, SF), ["n_email", "replaced__"]),
        (lambda df: piece_digests(df, PIECES), ["n_tokens"]), (lambda df: encode_texts(df, PIECES), ["ids"]), (lambda df: with_ids(df, BPE), ["ids"]),
        (lambda df: section_token_counts(df, BPE), ["section", "n_tokens"]), (lambda df: apply_rules(df, []), ["rule", "kept", "n_words"]), (lambda df: token_pieces(df, BPE), ["piece", "ids"]),
        (lambda df: pack(df.withColumn("length", df.doc_id), 10), ["sequence_id", "offset"]), (lambda df: one_of_each(df), ["node__", "turn__"]),
    ]
    for make, names in cases:
        out = make(frame(*names))
        assert len({c.lower() for c in out.columns}) == len(out.columns)
        row = out.collect()[0]
        assert all(row[n] == "old" for n in names), names
    pages = spark.createDataFrame([(1, "<p>words, of a page</p>", "old", "old")], "page_id long, html string, text string, n_chars string")
    (row,) = main_texts(pages).collect()
    assert (row["text"], row["text_"], row["n_chars_"]) == ("old", "words, of a page", 16)
    ids = decode_ids(encode_texts(frame("decoded"), PIECES), PIECES)
    assert ids.columns[-1] == "decoded_"


class Tree(HTMLParser):
    """Paths of a well-formed page, as plain tuples, by another parser."""

    def __init__(self):
        super().__init__()
        self.stack, self.found, self.now = [], [], None

    def handle_starttag(self, tag, attrs):
        self.stack.append((tag, dict(attrs).get("class")))
        if tag != "a":
            self.now = None

    def handle_endtag(self, tag):
        self.stack.pop()
        if tag != "a":
            self.now = None

    def handle_data(self, data):
        if self.now is None and not data.strip():
            return
        if self.now is None:
            self.now = [tuple(t for t in self.stack if t[0] != "a"), "", 0]
            self.found.append(self.now)
        self.now[1] += data
        if any(t == "a" for t, _ in self.stack):
            self.now[2] += len(data)


def plain_scores(page):
    """The scores as their docstring states them, path by path."""
    tree = Tree()
    tree.feed(page)
    found = [(p, " ".join(t.split()), n / len(t)) for p, t, n in tree.found]

    def place(path):
        articles = [k for k, (t, _) in enumerate(path) if t in ("article", "main")]
        if articles:
            return path[: articles[-1] + 1]
        best = ()
        for k, (t, _) in enumerate(path):
            listed = False
            for x, _ in path[: k + 1]:
                listed = (listed and x != "section") or x in ("ul", "table")
            if t in ("section", "div", "body") and not listed:
                best = path[: k + 1]
        return best

    def mean(rows, of, weight=lambda r: 1):
        total = sum(weight(r) for r in rows)
        return sum(of(r) * weight(r) for r in rows) / total if total else 0

    size = lambda r: len(r[1]) * (1 - r[2])
    marks = lambda r: (sum(r[1].count(c) for c in ".,;:!?") + 1) * (1 - r[2])
    holders = {}
    for r in found:
        holders.setdefault(place(r[0]), []).append(r)
    most = max((sum(map(size, rows)) for rows in holders.values()), default=0)
    out = {}
    for path in {r[0] for r in found}:
        mine, around = [r for r in found if r[0] == path], holders[place(path)]
        length, dense = ((mean(mine, f) + mean(around, f, size)) / 2 for f in (size, marks))
        out[path] = (length * dense * sum(map(size, around)) / most) ** 0.5 if most else 0.0
    level = mean(found, lambda r: out[r[0]], size) if most else 0
    return found, out, level


def random_page(rng, depth=0):
    if depth > 4 or rng.random() < 0.3:
        words = " ".join(rng.choice(["word", "text,", "end.", "more", "so!"]) for _ in range(rng.randint(1, 30)))
        return f'<p>{words} <a href="x">{words[: rng.randint(0, 30)]}</a></p>' if rng.random() < 0.4 else f"<p>{words}</p>"
    tag = rng.choice(["div", "section", "article", "ul", "div"])
    inner = "".join(f"<li>{random_page(rng, depth + 1)}</li>" if tag == "ul" else random_page(rng, depth + 1) for _ in range(rng.randint(1, 4)))
    return f"<{tag}>{inner}</{tag}>"


def test_page_scores_by_brute_force():
    rng = random.Random(20)
    for _ in range(150):
        page = f"<html><body>{''.join(random_page(rng) for _ in range(4))}</body></html>"
        found, want, level = plain_scores(page)
        got = blocks(page)
        assert [t for _, t, _ in got] == [t for _, t, _ in found]
        score, mine = scores(got)
        assert abs(mine - level) < 1e-6
        assert [round(score[p], 6) for p, _, _ in got] == [round(want[p], 6) for p, _, _ in found]


def article_and_advert(page):
    parts = page[page.index("<article>") : page.index("</article>")].replace("<br>", " ").replace("<b>", "").replace("</b>", "")
    texts = [" ".join(mainpage.html.unescape(x).split()) for x in mainpage.re.split(r"</?(?:p|h1|article)>", parts)]
    advert = mainpage.re.search(r'<div class="ad">(.*?)</div>', page, mainpage.re.S)[1]
    return [t for t in texts if t], " ".join(mainpage.html.unescape(advert).split())


@pytest.mark.parametrize("names", [mainpage.NAMES, frozenset()])
def test_scores_part_articles_from_adverts(monkeypatch, names):
    monkeypatch.setattr(mainpage, "NAMES", names)
    kept = wanted = adverts = 0
    pages = pq.read_table(f"{SF}/pages.parquet")["html"].to_pylist()
    for page in pages:
        texts, advert = article_and_advert(page)
        got = main_text(page).split("\n\n")
        wanted += len(texts)
        kept += sum(t in got for t in texts)
        adverts += advert in got and advert not in texts
    assert kept == wanted and adverts <= (0 if names else 0.15 * len(pages))


def test_names_weigh_and_do_not_decide():
    said = "A long sentence, which says something, and goes on for a while. "
    page = f'<body><article><h1>T</h1><p class="ad-free">{said}</p><div class="related-work"><h2>Related work</h2><p>{said}</p></div><p>{said * 3}</p></article><div class="comments"><p>{said * 2}</p></div></body>'
    assert main_text(page).split("\n\n") == ["T", said.strip(), "Related work", said.strip(), (said * 3).strip()]


def test_broken_and_deep_pages():
    assert main_text('<p>hello <a href="x>foo</a> world, and more.</p>') == "hello foo world, and more."
    assert main_text("<p title=it's>Hello, don't go.</p>") == "Hello, don't go."
    for page in ("<div>" * 20_000 + "deep words, here", "<div>a" * 20_000, "<p>x, y" * 20_000, "<ul><li>" * 10_000 + "x, y", '<a href="' * 5_000 + "x"):
        start = time.time()
        main_text(page)
        assert time.time() - start < 5


def test_dates_are_permuted_in_every_form():
    p = Pseudonyms(b"key")
    days = [datetime.date(1999, 1, 1) + datetime.timedelta(k) for k in range(800)]
    for form in ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d.%m.%Y"):
        values = [d.strftime(form) for d in days]
        new = [p.text(v)[0] for v in values]
        assert len(set(new)) == len(values)
        assert [p.text(v, back=True)[0] for v in new] == values
    # a late day has one pseudonym in every form
    iso, point, slash, us = (p.text(t)[0] for t in ("2021-03-25", "25.03.2021", "25/03/2021", "03/25/2021"))
    y, m, d = iso.split("-")
    assert (point, slash, us) == (f"{d}.{m}.{y}", f"{d}/{m}/{y}", f"{m}/{d}/{y}")


def test_the_key_comes_from_the_session(spark):
    df = spark.createDataFrame([(1, "write to ann.lee@mail.example.com")], "doc_id long, text string")
    plain = pseudonym_stage(spark, df, SF).collect()
    spark.conf.set("spark.chartweave.pseudonymKey", "00ff10")
    try:
        assert session_key(spark) == b"\x00\xff\x10"
        assert pseudonym_stage(spark, df, SF).collect() != plain
    finally:
        spark.conf.unset("spark.chartweave.pseudonymKey")


def test_long_texts_in_parts_give_equal_ids():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    text = ("The quick brown fox, é日  jumps\n\n over <|endoftext|> it's 12 " * 60 + "x" * 3000) * 3
    ids = library.encode(text, add_special_tokens=False).ids
    for longest in (1, 37, 1000, 10**6):
        assert WholeTextEncoder(BPE, longest=longest, added=True)(text).tolist() == ids


def test_passages_of_a_mixed_corpus_against_brute_force(spark):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(3000)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [prose(rng.randint(55, 250)) for _ in range(12)]
    lines = [prose(12) for _ in range(5)]
    docs = []
    for _ in range(260):
        out = prose(rng.randint(5, 60))
        for _ in range(rng.randint(0, 3)):
            part = list(rng.choice(shared))
            if rng.random() < 0.4:  # only a part of it
                at = rng.randrange(len(part))
                part = part[at : at + rng.randint(20, 60)]
            out += [rng.choice(words) if rng.random() < 0.06 else w for w in part] + rng.choice(lines) * rng.randint(0, 2) + prose(rng.randint(0, 40))
        docs.append(out)
    # words that lie on a diagonal of 60 with four in five equal to an earlier text must be found, most of them
    want = set()
    for d, a in enumerate(docs):
        where = {}
        for e in range(d):
            for q, w in enumerate(docs[e]):
                where.setdefault(w, []).append((e, q))
        diagonals = {}
        for p, w in enumerate(a):
            for e, q in where.get(w, ()):
                diagonals.setdefault((e, q - p), []).append(p)
        for ps in diagonals.values():
            for i in range(len(ps) - 47):
                if ps[i + 47] - ps[i] < 60:
                    want |= {(d, x) for x in range(ps[i], ps[i + 47] + 1)}
    got = set()
    found = repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")).collect()
    for r in found:
        got |= {(r.doc_id, x) for x in range(r.start, r.end)}
    assert len(want) > 5000 and len(want & got) >= 0.95 * len(want)
    assert all(r.first_id < r.doc_id for r in found)


def test_very_long_texts_and_null_ids(spark):
    rng = random.Random(22)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    rows = [(1, long), (2, long + " end"), (None, "the same text of more than five words"), (3, "the same text of more than five words"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in one_of_each(df).collect()) == [1, 3, 4, 5]
    (found,) = repeated_passages(df).collect()
    assert (found.doc_id, found.first_id, found.start) == (2, 1, 0) and found.end >= 60_000
    kept = {r.doc_id: r.text for r in passage_stage(spark, df, SF).collect() if r.doc_id}
    assert kept[1] == long and len(kept.get(2, "")) < 10
    assert pseudonym_stage(spark, df, SF).count() == 6 and apply_rules(df, []).count() == 6


def test_op1_keeps_rows_without_an_id(spark, tmp_path):
    spark.createDataFrame([(None, "the same text of more than five words"), (7, "the same text of more than five words"), (None, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.doc_id, r.class_id, r.class_size, r.kept) for r in op1_bag_minhash(spark, str(tmp_path)).collect()), key=repr)
    assert got == [(7, 7, 2, True), (None, 7, 2, False), (None, None, 1, True)]


def test_sequences_hold_the_packed_ids(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    texts = [None, "", "the " * 700] + [f"some words {i} " * (i % 40) for i in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    placed = pack(token_pieces(df, BPE, 256).cache(), 256, identity=["doc_id", "piece"]).cache()
    rows = {r.sequence_id: r.ids for r in packed_sequences(placed).collect()}
    assert sorted(rows) == sorted({r.sequence_id for r in placed.collect()}) and all(0 < len(x) <= 256 for x in rows.values())
    whole = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    for r in placed.collect():
        assert rows[r.sequence_id][r.offset : r.offset + r.length] == whole[r.doc_id][r.start : r.start + r.length]


def pipeline_input(spark, path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "src1", len(t) if t is not None else None) for i, t in rows], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(23)
    prose = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    base, passage = prose(120), prose(70)
    rows = [(i, prose(80)) for i in range(20)] + [(20, base), (21, base), (22, base + " more"), (23, prose(40) + " " + passage), (24, passage + " " + prose(40)), (25, prose(30) + " mail ann.lee@mail.example.com now"), (26, "few words"), (27, None), (None, prose(60)), (28, "")]
    pipeline_input(spark, tmp_path, rows)
    texts = {}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = out.checkpoint() if spark.sparkContext.getCheckpointDir() else out.cache()
        texts[name] = {r.doc_id: r.text for r in docs.collect()}
    judged, kept, cut, private = (texts[n] for n, _ in corpus_pipeline.STAGES[:-1])
    assert set(judged) == {*range(26), None} and set(kept) == {*range(21), 23, 24, 25, None}
    assert passage in cut[23] and passage not in cut[24] and len(cut[24].split()) >= 35
    assert cut[25] == private[25].replace(private[25].split()[31], "ann.lee@mail.example.com") and "ann.lee" not in private[25]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(private) and sum(r.length for r in out if r.doc_id == 0) > 80
    for s in {r.sequence_id for r in out}:
        parts = sorted((r.offset, r.length) for r in out if r.sequence_id == s)
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_pipeline_of_an_empty_table(spark, tmp_path):
    pipeline_input(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


LONG = "The committee met on Tuesday, and after a long debate it agreed, in the end, to publish the whole report with all of its tables and notes. "


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><meta charset=x><body><p>{LONG}</p><p>{LONG}</p></body></html>",
        f"<html><head><title>T</title><div><p>{LONG}</p><p>{LONG}</p></div>",
        f"<head><style>p {{}}</style></head><body><form action=/x><nav>Menu one</nav><input name=a><article><p>{LONG}</p><p>{LONG}</p></article><label>Your name</label><button>Send</button></form></body>",
        f"<body><form id=page><div><p>{LONG}</p><p>{LONG}</p></div><select><option>One</select></form>",
        f"<body><article><p>{LONG}</p><p>{LONG}</p></article><form><p>Subscribe to our letter, please.</p><input></form></body>",
        f"<body><article><p>{LONG}</p><p>{LONG}</p></article><section class=discussion><p>Nice, thank you, I agree.</p></section><div>Copyright 2020 Some Company, all rights reserved.</div></body>",
    ],
)
def test_pages_that_are_not_well_formed_keep_their_text(page):
    assert main_text(page) == f"{LONG.strip()}\n\n{LONG.strip()}"


def test_text_right_after_an_open_head():
    assert main_text(f"<head><title>T</title>\n {LONG}<p>{LONG}") == f"{LONG.strip()}\n\n{LONG.strip()}"


def test_own_names_of_columns_never_meet(spark):
    rows = [(1, "a b c d e f g", 5, 2), (2, "a b c d e f g", 6, 3), (3, None, 7, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id_ long, node_ long")
    assert sorted(map(tuple, one_of_each(df).collect()), key=repr) == [rows[0], rows[2]]
    pieces = spark.createDataFrame([(9, 5, 1, 2), (7, 6, 1, 2)], "length long, len__ long, salts__ long, n__ long")
    assert sorted((r["length"], r.len__, r.salts__, r.n__) for r in pack(pieces, 10).collect()) == [(7, 6, 1, 2), (9, 5, 1, 2)]


def test_one_id_in_several_labels(spark):
    near = [1.0, 0.01]
    rows = [(1, 0, [1.0, 0.0]), (2, 0, near), (2, 1, near), (5, 1, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (7, 1, [0.0, 2.0])]
    out = linked_vectors(spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>"))
    assert sorted(map(tuple, out.collect())) == sorted([(1, 1, 1, True), (2, 1, 1, False), (2, 1, 2, True), (5, 1, 2, False), (2, 1, 2, True), (7, 1, 2, False)])


def test_a_cluster_needs_a_key_of_its_own():
    from types import SimpleNamespace

    session = lambda master, key: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: key), sparkContext=SimpleNamespace(master=master))
    assert session_key(session("yarn", "00ff")) == b"\x00\xff" and session_key(session("local[2]", None))
    with pytest.raises(RuntimeError):
        session_key(session("yarn", None))


def test_a_cluster_without_a_key_gets_a_random_one(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://cluster:7077")
    docs = spark.createDataFrame([(1, "write to ann.lee@mail.example.com"), (2, "nothing")], "doc_id long, text string")
    with pytest.warns(UserWarning, match="pseudonymKey"):
        key = run_key(spark)
        told = sorted(map(tuple, pseudonym_stage(spark, docs, SF).collect()))
        rows = op10_feistel_pseudonyms(spark, SF).count()
    assert len(key) == 32 and key != DEMONSTRATION_KEY
    assert told[0][1] != "write to ann.lee@mail.example.com" and told[1] == (2, "nothing")
    assert Pseudonyms(key).text(told[0][1], back=True)[0] == "write to ann.lee@mail.example.com"  # all queries share the key
    assert rows == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_addresses_of_thousands_of_letters_come_back():
    p = Pseudonyms(b"key")
    for n in (3000, 3100, 9000):
        text = f"to {'abcdefghij' * (n // 10)}@mail.example.com"
        new, counts = p.text(text)
        assert sum(counts) == 1 and new != text and p.text(new, back=True)[0] == text
