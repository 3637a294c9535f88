"""The automaton's classification against one pattern for each word."""

import random
import re

from chartweave import rules
from chartweave.operators import lexicon, reports


def plain(text):
    low, best = text.lower(), (0.0, "Other", [])
    for name, (least, mandatory, listed) in rules.SUBTYPES.items():
        matched = [w for w in listed if re.search(rf"\b{re.escape(w)}\b" if len(w) <= 4 else re.escape(w), low, re.A)]
        must = sum(any(v in low for v in m.split("|")) for m in mandatory) / len(mandatory)
        score = must * 0.65 + min(1.0, len(matched) / lexicon.target(least, len(listed))) * 0.35
        if score > best[0] and len(matched) >= least:
            best = (score, name, matched)
    return best


def test_automaton_equals_patterns():
    rng = random.Random(1)
    words = [w for _, must, listed in rules.SUBTYPES.values() for w in [*listed, *(v for m in must for v in m.split("|"))]]
    seen = set()
    for _ in range(1500):
        pool = rng.choice([words, list(rng.choice(list(rules.SUBTYPES.values()))[2])])
        text = "".join(rng.choice(pool) + rng.choice([" ", "\n", "x", ".", "-", "é", "_", "/", ""]) for _ in range(rng.randint(0, 14)))
        score, name, matched = plain(text)
        kind, confidence, n, evidence, explanation, reason = lexicon.classify(text.upper() if rng.random() < 0.2 else text)
        assert evidence == matched and n == len(matched) and abs(confidence - score) <= 0.0006
        assert kind == (name if confidence >= rules.CLASSIFIED_FROM else "Other") and (explanation == rules.NO_TYPE) == (not matched)
        seen.add(kind)
    assert len(seen) > 12


def test_words_alone_at_the_ends():
    assert [w for w in ("rx", "/ul") if w in lexicon.matcher().found("rx 5/ul")[1]] == ["rx", "/ul"]
    assert not lexicon.matcher().found("xrx _rx rxé".replace("é", "e"))[1] & {"rx"} and "rx" in lexicon.matcher().found("érx")[1]
    assert lexicon.classify(None)[:4] == ("Other", 0.0, 0, [])


def test_names_in_texts(spark):
    texts = ["Hospital : City Care, Block 2\nDoctor: Ann Rao  Age 4\nName: Mr. Lee, M", "Sunrise Diagnostics Pvt\nseen by Dr. Jane Roe 2 pm", "none", None, "Lab:\n\n  Alpha"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "document_id int, text string")
    got = {r.document_id: tuple(r)[1:] for r in reports.document_names(df).collect()}
    assert got[0] == ("Lee", "City Care", "Ann Rao") and got[1] == (None, "Sunrise Diagnostics", "Jane Roe")
    assert got[2] == got[3] == (None, None, None) and got[4] == (None, "Alpha", None)
