"""Quality rules: fixed base rules, then a decision list that sequential covering learns from labels.

Only DataFrame functions touch rows. The learner sees a bounded sample of labelled rows as
numbers (``SAMPLE_ROWS``, chosen by a hash of the id), grows a conjunction of thresholds by
information gain, prunes it on held-out rows, takes what it covers away and goes on; the
rules become one ordered Spark conditional expression that runs over every row.

Defined cases: a null or empty text has no words and fails the base rules; without usable
labels the list is empty and the base rules alone decide; repeated rows (also of labels) and
ties give equal verdicts row by row; rows without an id are judged like others; an empty table
gives no rows; very long texts are measured whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import sampled, text_or_empty

#: Most labelled rows that the learner takes (expected number: the choice is by hash).
SAMPLE_ROWS = 20_000
#: Thresholds tried for each measure, conditions in a rule, rules in a list.
THRESHOLDS, CONDITIONS, RULES = 32, 3, 12
#: A pruned rule needs this precision on held-out rows and this many rows of the class it names.
PRECISION, SUPPORT = 0.95, 5

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: What rules may test: ratios, so that they hold for texts of any length.
MEASURES = {
    "mean_word": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "repeat_share": "n_repeat_words / n_words",
    "dup_lines_per_word": "n_dup_lines / n_words",
    "words": "n_words",
}

# Word positions that windows of five, found twice or more, cover: sort windows with their places, keep those equal to
# a neighbour, and let each add at most five words beyond the one before. transform(array(x), ...) binds x once.
_REPEATED = """
aggregate(
  sort_array(transform(
    element_at(transform(array(sort_array(arrays_zip(grams, places))),
      s -> filter(s, (e, k) -> coalesce(e.grams = get(s, k - 1).grams, false) or coalesce(e.grams = get(s, k + 1).grams, false))), 1),
    e -> e.places)),
  named_struct('total', 0L, 'last', -5),
  (a, p) -> named_struct('total', a.total + least(5, p - a.last), 'last', p),
  a -> a.total)
"""


def _fence(column: Column) -> Column:
    """The same values, but Catalyst moves no filter below them: it would put whole arrays' making into each lambda call."""
    return F.when(F.spark_partition_id() >= 0, column)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each whole text."""
    text = text_or_empty(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.array_remove(F.split(text, WHITE), "").alias("words"),
            lines.alias("lines"),
            (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        )
        .select(
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.char_length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
            "n_symbols",
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            _fence(F.transform("words", lambda w: F.xxhash64(w))).alias("hashes"),
        )
        .withColumn("grams", F.expr("if(n_words >= 5 and spark_partition_id() >= 0, transform(sequence(0, int(n_words) - 5), i -> xxhash64(hashes[i], hashes[i + 1], hashes[i + 2], hashes[i + 3], hashes[i + 4])), array())"))
        .withColumn("places", F.expr("if(n_words >= 5, sequence(0, int(n_words) - 5), array())"))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.expr(f"if(size(array_distinct(grams)) = size(grams), 0L, {_REPEATED})").alias("n_repeat_words"))
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(MEASURES[self.measure])
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


def labelled(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[tuple]:
    """(bad, *measures) of at most about ``most`` labelled documents that pass the base rules."""
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 0).alias("bad")).dropna()
    n = marks.count()
    if n == 0:
        return []
    marks = sampled(marks, n, most, "id", "bad")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chosen = chosen.join(F.broadcast(marks.select(F.col("id").alias("doc_id")).distinct()), "doc_id", "left_semi")  # bounded by ``most``
    rows = measures(chosen).filter(~base_failed()).join(F.broadcast(marks), F.col("doc_id") == F.col("id"))
    return [tuple(r) for r in rows.select("bad", *[F.expr(e).cast("double").alias(m) for m, e in MEASURES.items()], F.xxhash64("doc_id").alias("hash")).collect()]


def _bits(flags) -> int:
    """Flag i as bit i."""
    return int("".join("1" if x else "0" for x in flags)[::-1] or "0", 2)


def learn(rows: list[tuple]) -> list[list[Condition]]:
    """Sequential covering over rows (bad, *measures, hash): ordered rules that name bad rows.

    Sets of rows are bits of integers, so trying a condition is one AND and a bit count.
    """
    rows = sorted(rows, key=lambda r: (r[-1], r[:-1]))
    grow = _bits(r[-1] % 3 for r in rows)
    held = ((1 << len(rows)) - 1) & ~grow
    bad = _bits(r[0] for r in rows)
    candidates: list[tuple[Condition, int]] = []
    for m, name in enumerate(MEASURES, 1):
        values = sorted({r[m] for r in rows})
        cuts = sorted({values[len(values) * k // (THRESHOLDS + 1)] for k in range(1, THRESHOLDS + 1)}) if values else []
        for cut in cuts:
            over = _bits(r[m] > cut for r in rows)
            candidates += [(Condition(name, True, cut), over), (Condition(name, False, cut), ~over & ((1 << len(rows)) - 1))]

    def share(mask: int) -> float:
        return (mask & bad).bit_count() / max(1, mask.bit_count())

    rules: list[list[Condition]] = []
    left = (1 << len(rows)) - 1
    while len(rules) < RULES and (left & grow & bad).bit_count() >= SUPPORT:
        rule: list[tuple[Condition, int]] = []
        covered = left & grow
        while len(rule) < CONDITIONS and covered & ~bad:
            before = math.log2(share(covered)) if covered & bad else 0.0
            gain, best = max(((covered & mask & bad).bit_count() * (math.log2(share(covered & mask)) - before), -k) for k, (_, mask) in enumerate(candidates) if covered & mask & bad) if covered & bad else (0.0, 0)
            if gain <= 0:
                break
            rule.append(candidates[-best])
            covered &= candidates[-best][1]
        if not rule:
            break

        def worth(part: list[tuple[Condition, int]]) -> tuple[float, int]:
            mask = left & held
            for _, m in part:
                mask &= m
            good = (mask & bad).bit_count()
            return (2 * good - mask.bit_count()) / max(1, mask.bit_count()), good

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        mask = left
        for _, m in rule:
            mask &= m
        if share(mask & held) < PRECISION or share(mask & grow) < PRECISION or (mask & bad).bit_count() < SUPPORT:
            break
        rules.append([c for c, _ in rule])
        left &= ~mask
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as an ordered conditional: true keeps the row; the default keeps."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: measures, ``base_failed``, ``kept``."""
    rules = learn(labelled(docs, labels, id_col=id_col, text_col=text_col))
    return measures(docs, id_col, text_col).withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))
