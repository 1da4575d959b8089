"""Learned decision lists of text quality, in DataFrame expressions only."""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aircapture.llm.common import SEPARATOR, SPACES, cut, words

SYMBOLS = "[#*$%&|<>]+"
CAPITALS = "[A-Z]+"

#: What a rule may look at: measures of one text, as SQL.
FEATURES = {
    "n_words": "cast(n_words AS double)",
    "mean_word": "try_divide(word_chars, n_words)",
    "symbol_share": "try_divide(n_symbols, word_chars)",
    "dup_line_share": "try_divide(n_dup_lines, n_lines)",
    "repeat_share": "try_divide(n_repeat_words, n_words)",
    "capital_share": "try_divide(n_capitals, word_chars)",
    "line_words": "try_divide(n_words, n_lines)",
}


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and counts of each whole text.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``,
    ``n_dup_lines`` (lines with a word that equal an earlier line) and
    ``n_repeat_words`` (words in 3-word windows that occur twice or more), and
    the counts ``n_lines`` and ``n_capitals`` for learned rules.
    A null or empty text has zeros. One row per input row.
    """
    text = F.coalesce("text", F.lit(""))
    gone = lambda drop: F.length("_t") - F.length(F.regexp_replace("_t", drop, ""))
    d = docs.select("doc_id", text.alias("_t")).select("doc_id", "_t", words(F.col("_t")).alias("_w"))
    d = d.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", SEPARATOR, "")).cast("long").alias("word_chars"),
        gone(SYMBOLS).cast("long").alias("n_symbols"),
        gone(CAPITALS).cast("long").alias("n_capitals"),
        F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0).alias("_lines"),
        F.transform(
            F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)),
        ).alias("_h"),
    )
    d = d.withColumn("_again", F.size(F.array_distinct("_h")) < F.size("_h"))
    d = d.withColumn(
        "_z",
        F.when(F.col("_again"), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))),
    )
    d = d.withColumn(
        "_at",
        F.sort_array(
            F.transform(
                F.filter("_z", lambda s, j: (s.x == F.get("_z", j + 1).x) | (s.x == F.get("_z", j - 1).x)),
                lambda s: s.i,
            )
        ),
    )
    # windows start at _at: each adds the words that the one before did not cover
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a.n + F.least(F.lit(3), i - a.last)).alias("n")),
        lambda a: a.n,
    )
    return d.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        "n_capitals",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return F.coalesce(value > self.threshold if self.above else value <= self.threshold, F.lit(False))


@dataclass(frozen=True)
class Rule:
    """If all conditions hold, the text is of low quality."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: kept unless a rule fires."""
    out = None
    for r in rules:
        out = F.when(r.column(), False) if out is None else out.when(r.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Measures and label of at most ``max_rows`` labelled documents, picked by a hash of their id."""
    picked = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return measures(chosen).join(F.broadcast(picked), "doc_id")


def learn(
    sample: DataFrame,
    max_rules: int = 8,
    max_conditions: int = 3,
    bins: int = 24,
    min_precision: float = 0.8,
    min_rows: int = 5,
) -> list[Rule]:
    """Sequential covering over labelled measures.

    Thresholds are quantiles of each measure. A rule grows on two thirds of the
    rows by the condition of best information gain, is pruned to the prefix
    that is most precise on the last third, and the rows it covers leave. Each
    step is one grouped count over the rows still left; the driver sees
    measures x bins x labels counts, whatever the number of rows. No rules come
    of a sample without rows of both labels.
    """
    names = list(FEATURES)
    sample = cut(sample)  # read twice: for the quantiles and for the bins
    probs = [i / bins for i in range(1, bins)]
    low = (F.col("quality") == 0).cast("int")
    found = sample.agg(
        *(F.percentile_approx(F.expr(FEATURES[n]), F.array(*map(F.lit, probs)), 2000).alias(n) for n in names)
    ).first()
    cuts = {n: sorted(set(found[n] or [])) for n in names}
    bin_of = lambda n: sum(
        (F.when(F.expr(FEATURES[n]) > c, 1).otherwise(0) for c in cuts[n]), F.lit(0)
    )
    rows = cut(
        sample.select(
            low.alias("low"),
            (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) < 2).alias("grow"),
            F.array(*(F.when(F.expr(FEATURES[n]).isNotNull(), bin_of(n)) for n in names)).alias("bin"),
        ).repartition(4)  # of a sample of bounded size
    )
    place = {n: i for i, n in enumerate(names)}

    def holds(c: Condition) -> Column:
        at, k = F.get("bin", F.lit(place[c.feature])), cuts[c.feature].index(c.threshold)
        return F.coalesce(at > k if c.above else at <= k, F.lit(False))

    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules:
        conditions: list[Condition] = []
        inside = left
        before = None
        while len(conditions) < max_conditions:
            counts = (
                inside.where("grow")
                .select("low", F.posexplode("bin").alias("f", "b"))
                .groupBy("f", "b", "low")
                .count()
                .collect()
            )
            step = _best(counts, names, cuts, before, min_rows)
            if step is None:
                break
            condition, before = step
            conditions.append(condition)
            inside = inside.where(holds(condition))
            if before[1] == 0:
                break
        if not conditions:
            break
        kept = _pruned(left, conditions, holds)
        if kept is None or kept[1] < min_precision:
            break
        rules.append(Rule(kept[0]))
        fires = F.lit(True)
        for c in kept[0]:
            fires = fires & holds(c)
        left = left.where(~fires)
    return rules


def _best(counts, names, cuts, before, min_rows):
    """The condition of best FOIL gain, with the (low, other) rows it leaves; None if none gains."""
    tally: dict[int, dict[int, list[int]]] = {}
    for r in counts:
        if r["b"] is not None:
            tally.setdefault(r["f"], {}).setdefault(r["b"], [0, 0])[0 if r["low"] else 1] += r["count"]
    whole: dict[int, tuple[int, int]] = {
        f: (sum(x[0] for x in t.values()), sum(x[1] for x in t.values())) for f, t in tally.items()
    }
    if not whole:
        return None
    p0, n0 = before or max(whole.values())
    if not p0 or not n0:
        return None
    rate = log2(p0 / (p0 + n0))
    best = None
    for f, t in sorted(tally.items()):
        p = n = 0
        for k, threshold in enumerate(cuts[names[f]]):
            p += t.get(k, [0, 0])[0]
            n += t.get(k, [0, 0])[1]
            for above, (a, b) in ((False, (p, n)), (True, (whole[f][0] - p, whole[f][1] - n))):
                if a >= min_rows and (a, b) != (p0, n0):
                    gain = a * (log2(a / (a + b)) - rate)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, Condition(names[f], above, threshold), (a, b))
    return best and best[1:]


def _pruned(left: DataFrame, conditions: list[Condition], holds):
    """The prefix most precise on rows outside the grown part, and its precision; None without such rows."""
    aggs, all_of = [], F.lit(True)
    for i, c in enumerate(conditions):
        all_of = all_of & holds(c)
        aggs += [F.sum(F.when(all_of, F.col("low"))).alias(f"p{i}"), F.count(F.when(all_of, 1)).alias(f"a{i}")]
    r = left.where(~F.col("grow")).agg(*aggs).first()
    ranked = [
        ((r[f"p{i}"] or 0) / r[f"a{i}"], -i, tuple(conditions[: i + 1])) for i in range(len(conditions)) if r[f"a{i}"]
    ]
    if not ranked:
        return None
    precision, _, prefix = max(ranked, key=lambda x: x[:2])
    return prefix, precision


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Measures of every document with ``base_failed`` and ``kept`` (false, or the list's verdict)."""
    return (
        measures(docs)
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & verdict(rules))
    )
