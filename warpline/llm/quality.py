"""Quality rules: decision lists learned by sequential covering.

Statistics of every whole text are the only features. Rules are conjunctions of
thresholds that find low-quality documents. Each is grown one condition at a
time by information gain on two thirds of the rows, pruned from its end on the
last third, and kept while it stays precise; the rows it covers leave, and the
next rule is sought. The ordered list becomes one Spark conditional expression.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from warpline.plans.scratch import pick

#: Characters that count as symbols, and the white space that parts words.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: The base rule: fewest words, most words in repeated windows per hundred, words in a window.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Labelled rows that learning may use, about; only their statistics reach the driver.
SAMPLE_ROWS = 20_000
MAX_RULES, MAX_CONDITIONS, MAX_CUTS = 12, 4, 48
#: A rule stays only if at least this share of what it covers is of low quality.
MIN_PRECISION = 0.97
MIN_COVER = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct_words"]
STATS_DDL = ", ".join(f"{c} long" for c in COUNTS)


def statistics(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` of one whole text; all zero for a null one.

    Words are runs of anything but ASCII white space. ``n_repeat_words`` counts
    the words inside windows of five words that occur twice or more, the first
    occurrence included; ``n_dup_lines`` the lines with a word that equal an
    earlier line; ``n_marks`` exclamation and question marks.
    """
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = 0
    if n >= WINDOW:
        grams = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(grams)) < len(grams):
            seen = Counter(grams)
            end = 0
            for i, g in enumerate(grams):
                if seen[g] > 1:
                    repeated += i + WINDOW - max(i, end)
                    end = i + WINDOW
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), upper, text.count("!") + text.count("?"), len(set(words))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, COUNTS...)`` of every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*(statistics(t.as_py()) for t in b.column(1)))) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", *COUNTS])

    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, f"doc_id long, {STATS_DDL}")


def features() -> dict[str, Column]:
    """What conditions may test, as Spark columns over ``COUNTS``."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbols_per_word": per("n_symbols", "n_words"),
        "chars_per_word": per("word_chars", "n_words"),
        "dup_lines_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "marks_per_word": per("n_marks", "n_words"),
        "distinct_share": per("n_distinct_words", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut

    def column(self) -> Column:
        c = features()[self.feature]
        return c > F.lit(self.cut) if self.above else c <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: Rule = ()
    live = np.ones(len(bad), dtype=bool)
    while len(rule) < MAX_CONDITIONS:
        p0, n0 = int(bad[live].sum()), int((~bad[live]).sum())
        if not p0 or not n0:
            break
        base = math.log2(p0 / (p0 + n0))
        best = (0.0, None)
        for name in sorted(x):
            v, y = x[name][live], bad[live]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            edge = np.flatnonzero(v[1:] > v[:-1])
            if not len(edge):
                continue
            edge = edge[np.unique(np.linspace(0, len(edge) - 1, min(len(edge), MAX_CUTS * 8)).astype(int))]
            below = np.cumsum(y)[edge]
            size = edge + 1
            for above, p, t in ((False, below, size), (True, p0 - below, len(y) - size)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / t) - base), 0.0)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), Condition(name, above, float((v[edge[k]] + v[edge[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule += (best[1],)
        live &= best[1].holds(x)
    return rule


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    hit = _covers(rule, x, len(bad))
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 3) -> list[Rule]:
    """Rules that find the rows where ``bad``, in order; none where either kind is missing.

    A rule that is too weak is set aside with the rows that it covers, and the
    next one is sought among the others; it is judged by all rows that no rule
    covers yet.
    """
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    free = live = np.arange(len(bad))
    for _ in range(2 * MAX_RULES):
        if len(rules) == MAX_RULES or not bad[live].any() or bad[live].all():
            break
        mixed = rng.permutation(live)
        grow, prune = mixed[: 2 * len(mixed) // 3], mixed[2 * len(mixed) // 3 :]
        of = lambda rows: {k: v[rows] for k, v in x.items()}
        rule = _grow(of(grow), bad[grow])
        held = of(prune)
        while len(rule) > 1 and _worth(rule[:-1], held, bad[prune]) >= _worth(rule, held, bad[prune]):
            rule = rule[:-1]
        if not rule:
            break
        hit, held_hit = _covers(rule, of(free), len(free)), _covers(rule, held, len(prune))
        n, p = int(hit.sum()), int(bad[free][hit].sum())
        hn, hp = int(held_hit.sum()), int(bad[prune][held_hit].sum())
        live = live[~_covers(rule, of(live), len(live))]
        if n >= MIN_COVER and p >= MIN_PRECISION * n and hp >= MIN_PRECISION * hn:
            rules.append(rule)
            free = free[~hit]
    return rules


def rule_column(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 where none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test &= c.column()
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules of the labelled documents that pass the base rule.

    About ``rows`` labelled documents take part, drawn by a hash of doc_id. A
    label with null quality is none; of several labels the lowest counts. The
    texts are read on the executors, whole; the driver gets their statistics.
    """
    lab = pick(labels, "doc_id", "quality").where("doc_id is not null and quality is not null")
    lab = lab.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    n = lab.count()
    if not n:
        return []
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 24)) < F.lit(int(min(1.0, rows / n) * (1 << 24)) + 1)
    lab = lab.where(draw)
    texts = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).where(F.col("doc_id").isNotNull() & draw)
    stats = with_statistics(texts.join(lab, "doc_id", "left_semi")).join(lab, "doc_id").where(~base_failed())
    cols = features()
    got = stats.select("doc_id", (F.col("quality") == 0).alias("bad"), *[c.alias(k) for k, c in cols.items()]).limit(2 * rows).toPandas()
    got = got.sort_values(["doc_id", *cols], kind="stable")
    return learn({k: got[k].to_numpy() for k in cols}, got["bad"].to_numpy(dtype=bool))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdict of every row of ``docs(doc_id, text)``.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, rule (number of the learned rule that
    holds, 0 where none does). A null text has no words and so fails the base
    rule. Without labels nothing is learned and the base rule alone decides.
    Repeated rows give repeated results; other columns are ignored.
    """
    rules = fit(docs, labels)
    out = with_statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", rule_column(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject; columns as before, one pass over the texts."""
    rules = fit(docs, labels)
    names = docs.columns
    at = names.index("text")
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*(statistics(t.as_py()) for t in b.column(at)))) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in cols)], names=[*b.schema.names, *COUNTS])

    tagged = plain.mapInArrow(run, StructType([*plain.schema.fields, *(StructField(c, LongType()) for c in COUNTS)]))
    return tagged.where(~base_failed() & (rule_column(rules) == 0)).select(*plain.columns).toDF(*names)
