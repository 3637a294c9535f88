"""Payloads of any shape: entries and changes against plain recursion."""

import json
import random

from chartweave.operators import intake, variants

MISSING = object()


def random_value(rng, depth):
    kind = rng.random()
    if depth and kind < 0.45:
        keys = rng.sample(["a", "b", "sourceText", "source_text", "x.y", "q'r\"s", "é", ""], rng.randint(0, 4))
        return {k: random_value(rng, depth - 1) for k in keys}
    if depth and kind < 0.6:
        return [random_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([None, True, 0, 7, "", " Seen \t", "gout [", '{"', "É", "\\", 1.25, -3])


def plain_texts(value):
    if isinstance(value, dict):
        for k, v in value.items():
            if k in variants.SOURCE_KEYS and isinstance(v, str):
                if v.strip():
                    yield v.strip().lower()
            else:
                yield from plain_texts(v)
    if isinstance(value, list):
        for v in value:
            yield from plain_texts(v)


def same(a, b):
    return a is b if MISSING in (a, b) else json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)


def plain_changes(old, new, path=""):
    for k in dict.fromkeys([*old, *new]):
        a, b, at = old.get(k, MISSING), new.get(k, MISSING), f"{path}.{k}" if path else k
        if isinstance(a, dict) and isinstance(b, dict):
            yield from plain_changes(a, b, at)
        elif not same(a, b):
            yield at, *(None if v is MISSING else json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for v in (a, b))


def test_source_texts_at_any_depth(spark):
    rng = random.Random(1)
    values = [random_value(rng, 6) for _ in range(300)]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, None), (901, "{"), (902, ""), (903, '{"undeclared": [[{"deeper": {"sourceText": " Here "}}]]}')]
    got = variants.source_texts(spark.createDataFrame(rows, "document_id int, payload string"))
    want = {(i, t) for i, v in enumerate(values) for t in plain_texts(v)} | {(903, "here")}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert variants.source_texts(got.selectExpr("document_id", "source_text payload").limit(0)).count() == 0


def test_nesting(spark):
    texts = ["1", "[]", '{"a": [1, {"b": "]}"}]}', '"[["', '{"k\\"[": [[]]}', None, "", "]["]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(variants.nesting(df.t)).collect()] == [0, 1, 3, 0, 3, 0, 0, 0]


def test_changes_equal_plain_recursion(spark):
    rng = random.Random(2)
    olds = [{k: random_value(rng, 4) for k in "ab"} for _ in range(250)]
    news = []
    for v in olds:
        w = json.loads(json.dumps(v))
        for _ in range(rng.randint(0, 3)):
            at = w
            while (inner := [x for x in at.values() if isinstance(x, dict)]) and rng.random() < 0.7:
                at = rng.choice(inner)
            at[rng.choice(["a", "b", "c", "x.y"])] = random_value(rng, 3)
        news.append(w)
    rows = [(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(zip(olds, news, strict=True))]
    got = intake.corrections(spark.createDataFrame(rows, "document_id int, old string, new string"))
    want = [(i, *c) for i, (a, b) in enumerate(zip(olds, news, strict=True)) for c in plain_changes(a, b)]
    loaded = lambda v: None if v is None else json.dumps(json.loads(v), sort_keys=True)
    told = lambda rows: sorted(((i, p, loaded(v), loaded(w)) for i, p, v, w in rows), key=str)
    assert told(got.select("document_id", "path", "from_value", "to_value").collect()) == told(want) and len(want) > 100
    odd = spark.createDataFrame([(1, None, '{"a": null}'), (2, "{", "[]"), (3, "x", "x"), (4, '{"a": null}', "{}"), (5, '{"a": {"b": 1}}', '{"a": [1]}')], "document_id int, old string, new string")
    assert sorted((r.document_id, r.path, r.from_value, r.to_value) for r in intake.corrections(odd).collect()) == [(1, "a", None, "null"), (4, "a", "null", None), (5, "a", '{"b":1}', "[1]")]


def test_allergies_of_payloads(spark):
    from chartweave.operators import facts

    texts = ['{"allergies": ["Dust ", {"value": " Pollen"}, {"value": null}, {"value": 3}, 4, "", ["x"], {"name": "no"}, "Dust"]}', '{"allergies": "Dust"}', "{", None, '{"allergies": null}']
    rows = facts.payload_allergies(spark.createDataFrame([("p", t) for t in texts], "patient_id string, payload string"))
    assert sorted(map(tuple, rows.collect())) == [("p", "Dust"), ("p", "Pollen")]
