"""Near-duplicates, passages and vectors against brute force."""

import random
from collections import Counter

import numpy as np
from chartweave.llm.components import components
from chartweave.llm.neardup import PLACES, block_links, near_classes, one_of_each, op1_bag_minhash, overlap, shingle_bag, short_form, signatures
from chartweave.llm.common import word_hashes
from chartweave.llm.passages import GAP_COST, K, MOST_GAP, aligned, chains, cut_words, repeated_passages, without_passages
from chartweave.llm.vectors import linked_vectors

WORDS = [f"w{i}" for i in range(4000)]


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def classes_by_brute_force(texts):
    """Smallest index of each text's component; None for texts without words."""
    bags = []
    for t in texts:
        w = (t or "").split()
        k = min(5, len(w))
        bags.append(Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else None)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            if a and b:
                both = sum((a & b).values())
                if both >= 0.8 * (sum(a.values()) + sum(b.values()) - both):
                    x, y = sorted((root(i), root(j)))
                    parent[y] = x
    return [root(i) if bags[i] else None for i in range(len(texts))]


def near_corpus(rng):
    texts = [" ".join(prose(rng, rng.randint(1, 200))) for _ in range(60)]
    base = prose(rng, 150)
    for _ in range(120):  # a group whose members are mostly less alike than 0.8 among each other
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    texts += texts[:20] + [None, None, "", " \n", "a b", "a b", "one " * 300, "one " * 290]
    return texts


def test_word_hashes(monkeypatch):
    from chartweave.llm import common

    rng = random.Random(0)
    for stretch in (1 << 20, 16):
        monkeypatch.setattr(common, "STRETCH", stretch)
        seen = {}
        for _ in range(300):
            raw = "".join(rng.choice(["a", "b", "ab", " ", "\n", "\t", "\x1c", "\x85", "é", "\x00"]) for _ in range(rng.randint(0, 60))).encode()
            got = word_hashes(raw).tolist()
            assert len(got) == len(raw.split())
            for w, h in zip(raw.split(), got, strict=True):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen) > 300


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(1)
    a = [w.encode() for w in prose(rng, 400)] + [b"again"] * 90
    b = a[:300] + [b"again"] * 40 + [w.encode() for w in prose(rng, 60)]
    x, y = (shingle_bag(word_hashes(b" ".join(w))) for w in (a, b))
    assert x[1].max() > 50
    one, two = signatures([x, y], 4096)
    assert np.isfinite(one).all() and np.isfinite(two).all()
    assert abs((one == two).mean() - overlap(x, y)) < 4 * (0.25 / 4096) ** 0.5
    assert (signatures([x, x])[0] == signatures([y, x])[1]).all()
    assert np.isinf(signatures([shingle_bag(word_hashes(b" "))])).all()


def test_near_classes(spark):
    rng = random.Random(2)
    texts = near_corpus(rng)
    want = classes_by_brute_force(texts)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node__ string")
    got = {r.class_id: r.class_size for r in near_classes(df).collect()}
    sizes = Counter(w for w in want if w is not None)
    assert got == dict(sizes)
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([i for i, w in enumerate(want) if w in (i, None)])


def test_near_classes_odd_rows(spark):
    schema = "doc_id long, text string"
    assert near_classes(spark.createDataFrame([], schema)).count() == 0
    assert one_of_each(spark.createDataFrame([], schema)).count() == 0
    text = "the same text of more than five words"
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (None, text), (7, text), (None, "lonely text without id"), (8, None)], schema)
    got = one_of_each(df).collect()
    assert sorted((r.doc_id or -1) for r in got) == [-1, 5, 8]


def test_blocks_join_components():
    rng = random.Random(3)
    base = prose(rng, 100)
    texts = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in range(0, 100, 10)] + [" ".join(prose(rng, 50))]
    short = short_form(signatures([shingle_bag(word_hashes(t.encode())) for t in texts]))
    members = [{"node": bytes([i]), "component": bytes([i]), "signature": s.tobytes(), "bands": [7, 9], "text": t} for i, (t, s) in enumerate(zip(texts, short, strict=True))]
    assert block_links(members, members, 9, 0.8) == ([], [])  # compared in bucket 7
    a, b = block_links(members, members, 7, 0.8)
    assert len(a) == len(b) == 9 and bytes([10]) not in a + b and short.shape[1] == PLACES


def test_op1_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    got = op1_bag_minhash(spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id").class_id
    ids = docs.doc_id.tolist()
    assert [got[i] for i in ids] == [i if w is None else ids[w] for i, w in zip(ids, classes_by_brute_force(docs.text.tolist()), strict=True)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2300)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
            parent.setdefault(x, x)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chains_equal_the_quadratic_recurrence():
    rng = random.Random(5)
    for _ in range(100):
        n = rng.randint(1, 25)
        p, q = ([rng.randrange(60) for _ in range(n)] for _ in range(2))
        found = chains(p, q)
        seen = [i for c in found for i in c]
        assert len(seen) == len(set(seen))
        for c in found:
            assert all(p[i] < p[j] and q[i] < q[j] for i, j in zip(c, c[1:]))
    diagonal = list(range(0, 300, 6))
    assert chains(diagonal, [x + 40 for x in diagonal]) == [list(range(len(diagonal)))]


def quadratic_scores(p, q):
    """Best scores that end in each match, by all earlier matches within the gap."""
    score = [0.0] * len(p)
    for i in sorted(range(len(p)), key=lambda i: (p[i], q[i])):
        near = [j for j in range(len(p)) if 0 < p[i] - p[j] <= K + MOST_GAP and 0 < q[i] - q[j] <= K + MOST_GAP]
        score[i] = K + max([0.0, *(score[j] - GAP_COST * (p[i] - p[j] + q[i] - q[j]) for j in near)])
    return score


def test_best_chains_score_as_the_quadratic_recurrence():
    rng = random.Random(41)
    for _ in range(100):
        n = rng.randint(2, 60)
        p, q = ([rng.randrange(400) for _ in range(n)] for _ in range(2))
        found = chains(p, q)
        best = max(quadratic_scores(p, q))
        cost = lambda c: K * len(c) - GAP_COST * sum(p[i] - p[j] + q[i] - q[j] for j, i in zip(c, c[1:], strict=False))
        assert abs(max([K, *map(cost, found)]) - best) < 1e-9


def test_a_second_passage_of_two_documents_is_chained(spark):
    for n, between, m in ((150, 80, 60), (300, 150, 100), (1000, 300, 300)):
        p = [int(6.5 * k) for k in range(int(n / 6.5))] + [n + between + int(6.5 * k) for k in range(int(m / 6.5))]
        assert sorted(len(c) for c in chains(p, p)) == sorted([int(n / 6.5), int(m / 6.5)])
    rng = random.Random(42)
    a, b = prose(rng, 200), prose(rng, 70)
    texts = [" ".join(prose(rng, 30) + a + prose(rng, gap) + b + prose(rng, 30)) for gap in (90, 120)]
    got = repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.doc_id, r.first_id) for r in got] == [(1, 0)] * 2
    for (start, end), r in zip(((30, 230), (350, 420)), sorted(got, key=lambda r: r.start), strict=True):
        assert abs(r.start - start) <= 3 and abs(r.end - end) <= 3


def test_partners_share_a_whole_passage(spark):
    rng = random.Random(43)
    passage = prose(rng, 60)
    parts = [passage[:37], passage[24:], passage, passage[:37], passage[24:], passage]
    parts[3:3] = [passage[:37], passage[24:]] * 20
    texts = [" ".join(prose(rng, 20) + x + prose(rng, 20)) for x in parts]
    got = repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.doc_id, r.first_id) for r in got] == [(len(parts) - 1, 2)]
    assert abs(got[0].start - 20) <= 3 and abs(got[0].end - 80) <= 3


def test_passages_with_every_eighth_word_changed(spark):
    rng = random.Random(44)
    rows = []
    for k, n in enumerate((60, 60, 60, 100, 200)):
        a = prose(rng, n)
        b = [f"x{k}-{i}" if i % 8 == 7 else w for i, w in enumerate(a)]
        rows += [(2 * k, " ".join(prose(rng, 20) + a + prose(rng, 20))), (2 * k + 1, " ".join(prose(rng, 30) + b + prose(rng, 10)))]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.first_id) for r in got) == [(2 * k + 1, 2 * k) for k in range(5)]


def test_alignment_follows_edits():
    rng = random.Random(6)
    a = np.array([rng.randrange(60000) for _ in range(200)], np.uint16)
    b = np.concatenate([a[:90], [1, 2], a[90:150], a[152:]]).astype(np.uint16)
    ((s, t, u, v, n),) = aligned(a, b, [20, 100, 170], [20, 102, 170])
    assert (s, t, u, v) == (0, 200, 0, 200) and n == 198


def passage_corpus(rng):
    shared = [prose(rng, n) for n in (55, 80, 300)]
    rows = []
    for i in range(60):
        w = prose(rng, rng.randint(0, 150))
        if i % 3 == 0:
            some = list(shared[i // 3 % 3])
            if i % 2:
                some[len(some) // 2] = "edited"
            at = rng.randint(0, len(w))
            w[at:at] = some
        rows.append((i, " ".join(w)))
    return rows, shared


def test_passages_are_found_and_cut(spark):
    rng = random.Random(7)
    rows, shared = passage_corpus(rng)
    df = spark.createDataFrame([(i, t, len(t), "e") for i, t in rows], "doc_id long, text string, n_chars long, spans__ string")
    found = repeated_passages(df).toPandas()
    assert sorted(found.doc_id) == [i for i in range(9, 60, 3)]
    for r in found.itertuples():
        n = len(shared[r.doc_id // 3 % 3])
        assert n <= r.end - r.start <= n + 4
    out = without_passages(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    text = dict(rows)
    for i, r in got.items():
        assert r.n_chars == len(r.text)
        if i % 3 or i < 9:
            assert r.text == text[i]
        else:
            assert len(text[i].split()) - len(r.text.split()) in range(55, 305)
    assert set(text) - set(got) <= {i for i in range(9, 60, 3)}


def test_passages_odd_rows(spark):
    schema = "doc_id long, text string"
    assert repeated_passages(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(prose(random.Random(8), 80))
    rows = [(1, long), (1, long), (None, long), (2, None), (3, ""), (4, long), (5, "x " + long), (5, long + " y"), (6, "on " * 200), (7, "on " * 120)]
    df = spark.createDataFrame(rows, schema)
    got = repeated_passages(df).toPandas()
    assert set(got.doc_id) == {4, 7}  # id 5 stands for two texts
    kept = [(r.doc_id, r.text) for r in without_passages(df).collect()]
    assert len(kept) == 8 and (None, long) in kept and kept.count((1, long)) == 2


def test_cut_words():
    assert cut_words(" a b\nc  d", [(1, 3)]) == " a d"
    assert cut_words("a b", [(0, 2)]) == "" and cut_words("a b ", [(1, 2)]) == "a "


def test_vectors(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((150, 20))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    for i in range(150, 400):
        v = base[rng.integers(4)] + rng.standard_normal(20) * rng.choice([0.05, 0.12, 0.2])
        rows.append((i, v.tolist(), int(rng.integers(2))))
    rows += [(400 + i, base[5].tolist(), 1) for i in range(30)] + [(430, (base[5] * 3).tolist(), 1)]
    rows += [(500, None, 1), (501, [0.0] * 20, 1), (502, [float("nan")] * 20, 1), (503, [None] + [1.0] * 19, 1), (504, base[5].tolist(), None), (505, [], 1), (506, [1.0, 2.0], 1), (None, base[5].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in linked_vectors(df).collect()}
    good = [(i, np.array(v), k) for i, v, k in rows if i is not None and (i < 500)]
    unit = np.array([v / np.linalg.norm(v) for _, v, _ in good])
    near = (unit @ unit.T >= 0.98) & (np.array([k for *_, k in good])[:, None] == np.array([k for *_, k in good])[None])
    np.fill_diagonal(near, False)
    parent = list(range(len(good)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(near), strict=True):
        x, y = sorted((root(int(i)), root(int(j))))
        parent[y] = x
    for k, (i, _, _) in enumerate(good):
        assert (got[i].n_links, got[i].component_id) == (near[k].sum(), good[root(k)][0])
    assert near.sum() > 2000
    for i in [500, 501, 502, 503, 504, 505, 506]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert len(got) == len(rows) and linked_vectors(df.limit(0)).count() == 0


def test_full_cells_are_parted(spark, monkeypatch):
    from chartweave.llm import vectors

    monkeypatch.setattr(vectors, "PART", 16)
    rng = np.random.default_rng(10)
    rows = [(i, (np.ones(8) + rng.standard_normal(8) * 0.05).tolist(), 1) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    unit = np.array([np.array(v, np.float32).astype(float) for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    got = {r.vec_id: r.n_links for r in linked_vectors(df).collect()}
    assert got == {i: int(near[i].sum()) - 1 for i in range(120)}


def test_matches_on_one_diagonal_chain_as_others():
    from chartweave.llm.passages import on_diagonal

    rng = random.Random(46)
    for _ in range(200):
        p = np.unique([rng.randrange(900) for _ in range(rng.randint(1, 60))])
        want = sorted(([int(p[i]) for i in c] for c in chains(p.tolist(), (p + 7).tolist())))
        assert sorted(x.tolist() for x in on_diagonal(p)) == want
