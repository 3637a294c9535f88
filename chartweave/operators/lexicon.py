"""Types of reports by a lexicon: all words of all types in one automaton, which runs once over each text.

Words of up to four characters must stand alone, longer ones and mandatory ones may stand anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from math import floor

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules

CLASSIFICATION = T.StructType([
    T.StructField("document_type", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("n_matched", T.IntegerType()),
    T.StructField("matched_evidence", T.ArrayType(T.StringType())), T.StructField("explanation", T.StringType()), T.StructField("reason", T.StringType()),
])


def target(least: int, n: int) -> float:
    """How many keywords of ``n`` make a full score."""
    return max(least, min(5, n * 0.4))


def is_word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


class Matcher:
    """``anywhere`` and ``alone`` words by one automaton."""

    def __init__(self, anywhere: set[str], alone: set[str]):
        import ahocorasick

        self.anywhere, self.alone = anywhere, alone
        self.automaton = ahocorasick.Automaton()
        for word in anywhere | alone:
            self.automaton.add_word(word, word)
        self.automaton.make_automaton()

    def found(self, text: str) -> tuple[set[str], set[str]]:
        """The words that the text contains, and those that stand alone somewhere in it."""
        within, alone = set(), set()
        for end, word in self.automaton.iter(text):
            within.add(word)
            if word in self.alone and word not in alone:
                before, after = text[end - len(word) : end - len(word) + 1] if end >= len(word) else "", text[end + 1 : end + 2]
                if is_word(before or " ") != is_word(word[0]) and is_word(after or " ") != is_word(word[-1]):
                    alone.add(word)
        return within, alone


@lru_cache(1)
def matcher() -> Matcher:
    keywords = {w for _, _, listed in rules.SUBTYPES.values() for w in listed}
    mandatory = {v for _, must, _ in rules.SUBTYPES.values() for m in must for v in m.split("|")}
    return Matcher({w for w in keywords if len(w) > 4} | mandatory, {w for w in keywords if len(w) <= 4})


def percent(x: float) -> int:
    return floor(x * 100 + 0.5)


def classify(text: str | None) -> tuple[str, float, int, list[str], str, str]:
    """(type, confidence, matched keywords, these, explanation, reason): the best-scored subtype, the earlier of equals.

    0.65 of a score are the share of mandatory words, the rest the keywords against a target. A subtype competes
    with enough keywords; below 0.80 the type is Other.
    """
    within, alone = matcher().found((text or "").lower())
    best, name, evidence, explanation = 0.0, "Other", [], rules.NO_TYPE
    for subtype, (least, mandatory, listed) in rules.SUBTYPES.items():
        matched = [w for w in listed if w in (alone if len(w) <= 4 else within)]
        if len(matched) < least:
            continue
        must = sum(any(v in within for v in m.split("|")) for m in mandatory) / len(mandatory)
        score = must * 0.65 + min(1.0, len(matched) / target(least, len(listed))) * 0.35
        if score > best:
            best, name, evidence = score, subtype, matched
            explanation = rules.TYPE_FOUND.format(n=len(matched), name=rules.SHOWN_TYPES.get(subtype, subtype), percent=percent(must))
    confidence = float(Decimal(repr(best)).quantize(Decimal("0.001"), ROUND_HALF_UP))
    sure = confidence >= rules.CLASSIFIED_FROM
    reason = (rules.SURE_TYPE if sure else rules.UNSURE_TYPE).format(name=rules.SHOWN_TYPES.get(name, name), percent=percent(confidence), least=percent(rules.CLASSIFIED_FROM))
    return name if sure else "Other", confidence, len(evidence), evidence, explanation, reason


@F.pandas_udf(CLASSIFICATION)
def classification(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([classify(t) for t in batch], columns=CLASSIFICATION.names)
