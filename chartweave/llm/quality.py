"""Quality rules: a decision list learned by sequential covering, applied as ordered Spark conditions.

Statistics are counted per text in Arrow batches; the list is grown and pruned on the statistics of a
bounded sample of labelled rows; its verdict on every document is a chain of ``when`` expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, mix64, with_arrow

#: Characters that count as symbols; white space that parts words.
SYMBOLS = b"#*$%&|<>"
SPACE = b"\t\n\x0b\x0c\r "
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_digits", "n_exclaims", "n_pipes", "n_stops", "n_distinct_words"]


def repeated_words(ids: np.ndarray, k: int = 5) -> int:
    """Words that lie in runs of ``k`` words found twice or more, the first included."""
    n = len(ids) - k + 1
    if n < 2:
        return 0
    runs = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            runs = runs * np.uint64(0x9E3779B97F4A7C15) + ids[i : n + i]
        runs = mix64(runs)
    order = np.argsort(runs, kind="stable")
    same = runs[order[1:]] == runs[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n + k, np.int64)
    starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    np.add.at(twice, starts, 1)
    np.add.at(twice, starts + k, -1)
    return int((np.cumsum(twice)[: n + k - 1] > 0).sum())


def text_statistics(text: str | None) -> tuple[int, ...]:
    """The numbers named in BASE and MORE. A null text counts as an empty one."""
    raw = (text or "").encode()
    words = raw.split()  # bytes part at the six ASCII white-space characters only
    if not words:
        return (0,) * (len(BASE) + len(MORE))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    return (
        len(words),
        len(text) - int(seen[list(SPACE)].sum()),
        int(seen[list(SYMBOLS)].sum()),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(lines),
        int(seen[65:91].sum()),
        int(seen[48:58].sum()),
        int(seen[33]),
        int(seen[124]),
        int(seen[46]),
        len(set(words)),
    )


def with_statistics(df: DataFrame, text: str, names: list[str]) -> DataFrame:
    def make():
        def work(texts):
            table = np.array([text_statistics(t) for t in texts], np.int64).reshape(len(texts), len(names))
            return [pa.array(table[:, i]) for i in range(len(names))]

        return work

    return with_arrow(df, [text], [T.StructField(n, T.LongType()) for n in names], make)


def features(at: dict[str, Column]) -> dict[str, Column]:
    """Ratios on which rules are built. ``at`` maps the names of BASE and MORE to columns."""
    words, chars = F.greatest(at["n_words"], F.lit(1)), F.greatest(at["word_chars"], F.lit(1))
    lines = F.greatest(at["n_lines"], F.lit(1))
    return {
        "words": at["n_words"] * 1.0,
        "word_length": at["word_chars"] / words,
        "symbols": at["n_symbols"] / words,
        "dup_lines": at["n_dup_lines"] / lines,
        "repeats": at["n_repeat_words"] / words,
        "uppers": at["n_upper"] / chars,
        "digits": at["n_digits"] / chars,
        "exclaims": at["n_exclaims"] / words,
        "pipes": at["n_pipes"] / words,
        "stops": at["n_stops"] / words,
        "line_words": at["n_words"] / lines,
        "distinct": at["n_distinct_words"] / words,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x >= self.threshold if self.above else x < self.threshold

    def column(self, at: dict[str, Column]) -> Column:
        x = at[self.feature]
        return x >= F.lit(self.threshold) if self.above else x < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, table: dict[str, np.ndarray]) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(table) for c in rule))


def take(table: dict[str, np.ndarray], where: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[where] for k, v in table.items()}


def grow(table: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> Rule:
    """Conditions added one by one, each the one with the largest information gain for the class ``bad``."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < most and bad[inside].any() and not bad[inside].all():
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        now, best = np.log2(p / (p + n)), (0.0, None)
        for name, at in cuts.items():
            x, y = table[name][inside], bad[inside]
            spots = np.searchsorted(at, x, side="right")
            pos, neg = (np.bincount(spots[c], minlength=len(at) + 1) for c in (y, ~y))
            for above in (True, False):
                # rows at or above threshold i are those with spots > i
                pi, ni = ((v.sum() - np.cumsum(v)[:-1]) if above else np.cumsum(v)[:-1] for v in (pos, neg))
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pi > 0, pi * (np.log2(pi / np.maximum(pi + ni, 1)) - now), 0)
                i = int(np.argmax(gain))
                if gain[i] > best[0] + 1e-9:
                    best = (gain[i], Condition(name, above, float(at[i])))
        if best[1] is None:
            break
        rule = (*rule, best[1])
        inside &= best[1].holds(table)
    return rule


def prune(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The prefix of the rule that does best, (p - n) / (p + n), on rows it was not grown on; the shorter one of equals."""
    best, kept = -2.0, rule
    for k in range(1, len(rule) + 1):
        hit = covers(rule[:k], table)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best + 1e-12:
            best, kept = worth, rule[:k]
    return kept


def learn(table: dict[str, np.ndarray], bad: np.ndarray, *, precision: float = 0.9, least: int = 3, rules: int = 24, depth: int = 4, bins: int = 64) -> list[Rule]:
    """A decision list for ``bad``: rules in order; a row that none covers is good.

    Two thirds of the rows grow rules and the rest prune them, parted by position. A rule stays if its
    precision on all rows still uncovered is at least ``precision`` and it covers ``least`` bad rows.
    """
    cuts = {k: np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1])) for k, v in table.items()} if len(bad) else {}
    for k, v in table.items():  # also the midpoints that part the classes, so that rare values get thresholds
        if len(bad) and bad.any():
            cuts[k] = np.unique(np.concatenate([cuts[k], np.quantile(v[bad], np.linspace(0, 1, bins + 1))]))
    out: list[Rule] = []
    left = np.ones(len(bad), bool)
    held = np.arange(len(bad)) % 3 == 2
    while len(out) < rules and bad[left].sum() >= least:
        growing, pruning = left & ~held, left & held
        rule = grow(take(table, growing), bad[growing], cuts, depth)
        if not rule:
            break
        if bad[pruning].any():
            rule = prune(rule, take(table, pruning), bad[pruning])
        hit = covers(rule, table) & left
        p = (hit & bad).sum()
        if p < least or p / hit.sum() < precision:
            break
        out.append(rule)
        left &= ~hit
    return out


def verdict(rules: list[Rule], at: dict[str, Column]) -> Column:
    """The number of the first rule that covers a row, from 1; 0 if none does."""
    chain = F
    for i, rule in enumerate(rules, 1):
        chain = chain.when(reduce(lambda a, b: a & b, (c.column(at) for c in rule)), i)
    return chain.otherwise(0) if rules else F.lit(0)


def base_failed(at: dict[str, Column]) -> Column:
    return (at["n_words"] < 10) | (100 * at["n_repeat_words"] > 20 * at["n_words"])


def fit_rules(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = 20_000, **how) -> list[Rule]:
    """Rules for rows labelled 0, learned from at most ``sample`` labelled ids (those with the smallest hashes).

    Only that bounded sample is broadcast and brought to the driver, as numbers. Rows with a null label or
    id, and documents without a label, do not take part. Without usable labels the list is empty.
    """
    label_id, mark = "label_id__", "label__"
    picked = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias(label_id)).agg(F.max(label).cast("int").alias(mark))
    picked = picked.orderBy(F.xxhash64(label_id), label_id).limit(sample)
    rows = docs.select(F.col(doc_id).alias("id__"), F.col(text).alias("body__"))
    rows = rows.join(F.broadcast(picked), F.col("id__") == F.col(label_id)).select("id__", mark, "body__")
    rows = with_statistics(rows, "body__", [*BASE, *MORE]).drop("body__")
    rows = rows.where(~base_failed({n: F.col(n) for n in BASE}))
    shown = features({n: F.col(n) for n in [*BASE, *MORE]})
    frame = rows.select("id__", mark, *(c.alias(k) for k, c in shown.items())).orderBy(F.xxhash64("id__"), *shown).limit(sample).toPandas()
    table = {k: frame[k].to_numpy(float) for k in shown}
    return learn(table, frame[mark].to_numpy() == 0, **how)


VERDICT = ["base_failed", "rule", "kept"]


def apply_rules(docs: DataFrame, rules: list[Rule], *, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with the five base numbers, ``base_failed``, ``rule`` (0: none) and ``kept``.

    Null and empty texts fail the base test. Each row is judged by itself, so repeated rows get equal verdicts; an empty
    table gives an empty one; texts may have any length. A new column whose name is taken gets underscores behind
    it; the last column is the verdict in any case.
    """
    names = fresh(docs, *BASE, *MORE, *VERDICT)
    at = dict(zip([*BASE, *MORE], [F.col(n) for n in names], strict=False))
    out = with_statistics(docs, text, names[: -len(VERDICT)])
    failed, found = base_failed(at), verdict(rules, features(at))
    said = [c.alias(n) for c, n in zip((failed, found, ~failed & (found == 0)), names[-len(VERDICT) :], strict=True)]
    return out.select(*docs.columns, *(F.col(n) for n in names[: len(BASE)]), *said)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base test and that no learned rule rejects.

    Documents with a null or empty text go; repeated rows stay or go together; without labels only the base test counts.
    """
    rules = fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = apply_rules(docs, rules)
    return judged.where(F.col(judged.columns[-1])).select(*docs.columns)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word statistics and the learned verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return apply_rules(docs, rules).drop("text")
