"""Toxicity by a weighted finite-state grammar over the clauses of a text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aircapture.llm.common import cut

# Closed word classes of the four languages: fixed values.
TARGETS = "you your yours youre u he she they du dich dir dein ihr euch tu toi te vous tú ti usted ustedes vosotros"
NEGATIONS = "not no never isn't aren't wasn't don't nicht kein keine nie pas jamais aucun nunca jamás ningún"
REPORTS = "said says say quoted quotes wrote called sagte sagt schrieb dit disait écrit dijo dice escribió"
THREATS = "kill murder destroy stab strangle töten umbringen vernichten erwürgen tuer détruire égorger matar destruir asesinar"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
CLASSES = {
    **dict.fromkeys(THREATS.split(), THREAT),
    **dict.fromkeys(TARGETS.split(), TARGET),
    **dict.fromkeys(NEGATIONS.split(), NEGATION),
    **dict.fromkeys(REPORTS.split(), REPORT),
}

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[\"“”„«»]")
_CLAUSE_END = re.compile(r"[.!?;:\n]+")
_QUOTES = frozenset("\"“”„«»")


@dataclass(frozen=True)
class Fst:
    """Deterministic weighted transducer over token classes: (state, class) -> (state, weight, mark).

    A missing arc leaves the state's default: back to state 0 with weight 1.
    """

    arcs: dict[tuple[int, int], tuple[int, float, str]]

    def step(self, state: int, kind: int) -> tuple[int, float, str]:
        return self.arcs.get((state, kind), (0, 1.0, ""))

    def compose(self, other: Fst) -> Fst:
        """The product machine: both read the same classes, weights multiply and marks join."""
        index, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        for pair in todo:  # grows while it is read
            for kind in range(6):
                a, b = self.step(pair[0], kind), other.step(pair[1], kind)
                to = (a[0], b[0])
                if to not in index:
                    index[to] = len(index)
                    todo.append(to)
                arcs[index[pair], kind] = (index[to], a[1] * b[1], a[2] + b[2])
        return Fst(arcs)


def _memory(trigger: int, steps: int, weight: float, mark: str) -> Fst:
    """For ``steps`` tokens after a trigger, insults and threats weigh ``weight`` times as much and carry the mark."""
    arcs: dict[tuple[int, int], tuple[int, float, str]] = {}
    for s in range(steps + 1):
        for kind in range(6):
            if kind == trigger:
                arcs[s, kind] = (steps, 1.0, "")
            elif s:
                hit = kind in (INSULT, THREAT)
                arcs[s, kind] = (s - 1, weight if hit else 1.0, mark if hit else "")
    return Fst(arcs)


def grammar(weights: dict[str, float]) -> Fst:
    """Insult and threat machine composed with target, negation and reported-speech machines."""
    hits = Fst({(0, INSULT): (0, weights["I"], "I"), (0, THREAT): (0, weights["H"], "H")})
    out = hits.compose(_memory(TARGET, 3, weights["t"], "t"))
    out = out.compose(_memory(NEGATION, 2, weights["n"], "n"))
    return out.compose(_memory(REPORT, 6, weights["r"], "r"))


#: Reliability of a match before any training: threats need a target, denial and quotation weaken.
PRIOR = {"I": 0.9, "H": 0.4, "t": 1.1, "n": 0.5, "r": 0.6}


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)  # whole words -> reliability
    stems: dict[str, float] = field(default_factory=dict)  # word beginnings -> reliability
    patterns: dict[str, float] = field(default_factory=dict)  # mark of a match -> reliability, learned
    rest: float = 0.02  # score of a text without a match


def in_training(doc_id: Column) -> Column:
    """The rows whose labels may be learned: crc32 of the id's text is not divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    known = labels.where(in_training(F.col("doc_id")) & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where("text is not null")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 30_000, min_support: int = 3) -> Model:
    """Learn insults and the reliability of patterns from at most ``max_rows`` labelled training rows.

    Words and word beginnings that mark toxic texts are counted by Spark. A
    word stays only if it is about as frequent as the best marker in most of
    its texts, so other words of a text copied many times do not. Without
    toxic or without clean rows the model has no insults. The sample bounds
    what is broadcast and what the driver sees.
    """
    sample = cut(_sample(docs, labels, max_rows))
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Model()
    tokens = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    said = sample.select("doc_id", "toxic", F.explode(tokens).alias("word")).where(F.length("word").between(2, 40))
    counts = said.groupBy("word").agg(
        F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"), F.count("*").alias("n")
    ).where("n >= 2")
    odds = F.log((F.col("pos") + 0.5) / (toxic + 1)) - F.log((F.col("neg") + 0.5) / (clean + 1))
    rate = toxic / (toxic + clean)
    words = cut(counts.withColumn("odds", odds))
    # so many toxic texts with a word and no clean one that chance gives it to about ten of the words
    chance = math.log(max(words.count() / 10, 2)) / math.log(1 / rate)
    support = max(min_support, math.ceil(chance))
    strong = (F.col("odds") >= 3) & (F.col("pos") >= support) & (F.col("neg") <= 0.1 * F.col("pos"))
    precision = (F.col("pos") + rate) / (F.col("pos") + F.col("neg") + 1)

    # beginnings shared by several words of toxic texts and by next to none of clean ones
    begin = F.explode(F.expr("filter(transform(sequence(4, 6), k -> if(length(word) > k, left(word, k), null)), s -> s is not null)"))
    stems = (
        words.select("pos", "neg", begin.alias("stem"))
        .groupBy("stem")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum((F.col("pos") > 0).cast("int")).alias("kinds"))
        .where((F.col("kinds") >= 4) & (F.col("pos") >= 4 * support) & (F.col("neg") <= 0.02 * F.col("pos")))
        .select("stem", "pos", precision.alias("p"))
        .collect()
    )
    chosen: dict[str, tuple[float, int]] = {}
    for r in sorted(stems, key=lambda r: (len(r["stem"]), r["stem"])):
        if not any(r["stem"].startswith(s) for s in chosen):
            chosen[r["stem"]] = (r["p"], r["pos"])

    # a text's own markers are those about as frequent as its best one, stems included
    of_stem = F.lit(None).cast("long")
    if chosen:
        known = F.create_map(*(F.lit(x) for s, (_, n) in chosen.items() for x in (s, n)))
        of_stem = F.coalesce(*(F.try_element_at(known, F.left("word", F.lit(k))) for k in (4, 5, 6)))
    candidates = words.where(strong | of_stem.isNotNull()).withColumn("by_stem", of_stem)
    marked = said.where("toxic = 1").join(candidates.select("word", "pos", "by_stem"), "word")
    best = marked.groupBy("doc_id").agg(F.max(F.coalesce("by_stem", "pos")).alias("top"))
    votes = (
        marked.where("by_stem is null")
        .join(best, "doc_id")
        .groupBy("word")
        .agg(F.sum((F.col("pos") * 5 >= F.col("top")).cast("int")).alias("votes"), F.first("pos").alias("pos"))
        .where((F.col("votes") >= support) & (F.col("votes") * 2 >= F.col("pos")))
    )
    lexicon = {
        r["word"]: r["p"]
        for r in candidates.join(votes.select("word"), "word").select("word", precision.alias("p")).collect()
    }
    chosen = {s: p for s, (p, _) in chosen.items()}
    model = Model(lexicon, chosen)
    seen = _patterns(sample, model)
    for mark, (pos, all_) in seen.items():
        if mark:
            model.patterns[mark] = (pos + 4 * _prior(mark)) / (all_ + 4)
    pos, all_ = seen.get("", (0, 0))
    model.rest = min(0.4, (pos + 0.02 * 50) / (all_ + 50))
    return model


def _prior(mark: str) -> float:
    out = 1.0
    for m in mark:
        out *= PRIOR[m]
    return min(out, 0.98)


def _patterns(sample: DataFrame, model: Model) -> dict[str, tuple[int, int]]:
    """For each mark, how many of the sample's texts whose first match carries it are toxic, of how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            marks = []
            for t in b.column("text").to_pylist():
                found = scorer.matches(t)
                marks.append(max(found, key=lambda m: _prior(m[1]))[1] if found else "")
            yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int64()), pa.array(marks, pa.string())], ["toxic", "mark"])

    rows = sample.select("toxic", "text").mapInArrow(run, "toxic long, mark string")
    found = rows.groupBy("mark").agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).collect()
    return {r["mark"]: (r["p"], r["n"]) for r in found}


class Scorer:
    """Finds lexicon hits in a text, then runs the composed grammar over each clause that has one."""

    def __init__(self, model: Model) -> None:
        import ahocorasick

        self.model, self.fst = model, grammar(PRIOR)
        self.auto = ahocorasick.Automaton()
        for w in {**model.words, **model.stems, **{w: 0 for w in THREATS.split()}}:
            self.auto.add_word(w, w)
        self.auto.make_automaton()

    def _hits(self, low: str) -> Iterator[tuple[int, int]]:
        model, n = self.model, len(low)
        for end, w in self.auto.iter(low):
            start = end - len(w) + 1
            if start and low[start - 1].isalnum():
                continue
            if w in model.stems or end + 1 == n or not low[end + 1].isalnum():
                yield start, end + 1

    def _kind(self, word: str) -> tuple[int, float]:
        p = self.model.words.get(word)
        if p is None:
            p = max((self.model.stems.get(word[:k], 0.0) for k in (4, 5, 6) if len(word) > k), default=0.0)
        if p:
            return INSULT, p
        if word in _QUOTES:
            return REPORT, 0.0
        kind = CLASSES.get(word, OTHER)
        return kind, 0.9 if kind == THREAT else 0.0

    def matches(self, text: str) -> list[tuple[float, str, float]]:
        """(reliability of the word, mark of the pattern, the grammar's weight) of each match."""
        low, out, done = text.lower(), [], -1
        for start, end in self._hits(low):
            if start < done:
                continue
            a = max((m for m in (low.rfind(c, 0, start) for c in ".!?;:\n")), default=-1) + 1
            stop = _CLAUSE_END.search(low, end)
            done = stop.start() if stop else len(low)
            state = 0
            for word in _TOKEN.findall(low[a:done]):
                kind, p = self._kind(word)
                state, weight, mark = self.fst.step(state, kind)
                if mark and p:
                    out.append((p, mark, weight))
        return out

    def score(self, text: str | None) -> float:
        found = self.matches(text) if text else []
        if not found:
            return self.model.rest
        doubt = 1.0
        for p, mark, weight in found:
            doubt *= 1 - p * self.model.patterns.get(mark, min(weight, 0.98))
        return max(self.model.rest, 1 - doubt)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents' rows with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Null and empty texts get the score of a text without a match. Columns of
    the same names in the input are replaced.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(*(F.col(f"`{c}`") for c in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            scores = [scorer.score(t) for t in b.column("text").to_pylist()]
            arrays = [b.column(c) for c in names] + [pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "score"])

    scored = rows.mapInArrow(run, rows.withColumn("score", F.lit(0.0)).schema)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
