"""Toxicity by maximum-scoring segments of token log-odds.

From labelled texts every term (a word, or its beginning of 3 to 7 letters) gets the log-odds of occurring in a toxic
document, with a Dirichlet prior of its share in all; terms whose log-odds exceed ``LEAST_ODDS`` and ``Z`` standard errors are kept, at
most ``MAX_TERMS`` by the latter. A word scores as its longest kept term, other words as the (slightly negative) log-odds of an
unremarkable word. The linear-time scan of Ruzzo and Tompa finds all maximal-scoring segments of a text. By extreme-value
statistics (Karlin and Altschul) the number of segments of score S expected by chance in n words is K n exp(-lambda S);
lambda and K come from the words of non-toxic texts. The logarithms of these expectations, summed over the significant
segments, are the evidence that raises the share of toxic texts to the score.

The fit takes at most ``MAX_LABELLED`` labelled documents (those of least hash of doc_id), each text once. Scoring covers whole
texts and uses the text alone.

Defined results: NULL equals an empty text; a text without toxic segments has a score below the share of toxic texts. Labels
that are NULL or without a document are left out; without any toxic label every score is 0. Repeated rows score alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from zephra.llm.catalog import query, table

MAX_LABELLED = 12_000
MAX_TERMS = 20_000
PREFIXES = (7, 6, 5, 4, 3)
Z = 3.6
LEAST_ODDS = 3.5
PRIOR = 0.5
PRIOR_SHARE = 10.0
PRIOR_ALL = 20.0
CUT = 0.7
_CACHE_WORDS = 1 << 18
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def terms_of(word: str) -> list[str]:
    """The word, then its beginnings, longest first."""
    return ["=" + word, *[word[:k] for k in PREFIXES if len(word) > k]]


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    neutral: float = -0.02
    decay: float = 1.0  # lambda
    rate: float = 1.0  # K
    share: float = 0.0
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, w: str) -> float:
        """Log-odds of a word; 0 stands for an unremarkable one."""
        s = self.known.get(w)
        if s is None:
            if len(self.known) >= _CACHE_WORDS:
                self.known.clear()
            s = self.known[w] = next((self.terms[t] for t in terms_of(w) if t in self.terms), 0.0)
        return s

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and (first word, last word + 1, score) of all maximal-scoring segments."""
        words = words_of(text)
        scores = list(map(self.word, words))
        hits = [(i, s) for i, s in enumerate(scores) if s]
        return len(words), maximal_segments(hits, self.neutral)

    def score(self, text: str | None) -> float:
        if not self.terms:
            return 0.0
        n, found = self.segments(text)
        evidence = -1.0 if not found else 0.0
        for _, _, s in found:
            evidence += max(0.0, self.decay * s - math.log(max(self.rate * n, 1e-12)))
        odds = math.log(self.share / (1 - self.share)) + evidence
        return 1 / (1 + math.exp(-min(max(odds, -40.0), 40.0)))


def maximal_segments(hits: list[tuple[int, float]], neutral: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of a sequence given by its (place, score) other than ``neutral``; linear time."""
    kept: list[list[float]] = []  # first place, end, sum before, sum after
    total, last = 0.0, -1
    for at, s in hits:
        total += neutral * (at - last - 1)
        last = at
        if s <= 0:
            total += s
            continue
        new = [at, at + 1, total, total + s]
        total += s
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j -= 1
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:]
    return [(int(a), int(b), r - q) for a, b, q, r in kept]


def log_odds(y1: float, y0: float, n1: float, n0: float) -> tuple[float, float]:
    """Difference of log-odds between toxic and other documents, and its number of standard errors."""
    a = PRIOR + PRIOR_SHARE * (y1 + y0) / max(1.0, n1 + n0)
    d = math.log((y1 + a) / (n1 - y1 + PRIOR_ALL - a)) - math.log((y0 + a) / (n0 - y0 + PRIOR_ALL - a))
    return d, d / math.sqrt(1 / (y1 + a) + 1 / (y0 + a))


def _decay(counts: dict[float, float], neutral: float, n: float) -> float:
    """lambda > 0 with the mean of exp(lambda score) over background words equal to 1."""
    hits = sum(counts.values())

    def excess(lam: float) -> float:
        return sum(c * math.exp(min(lam * s, 600)) for s, c in counts.items()) + (n - hits) * math.exp(lam * neutral) - n

    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return (low + high) / 2


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Model from ``labels`` (doc_id, toxic)."""
    some = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna()
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy(F.xxhash64("text")).agg(
        F.min(F.struct("doc_id", "toxic", "text")).alias("r")
    ).select("r.text", (F.col("r.toxic") > 0).cast("int").alias("toxic"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for text, y in zip(b["text"], b["toxic"], strict=True):
                seen[("", y)] += 1  # the number of documents
                seen.update((t, y) for t in {t for w in set(words_of(text)) for t in terms_of(w)})
            if len(seen) > 500_000:
                yield pd.DataFrame({"term": [k[0] for k in seen], "toxic": [k[1] for k in seen], "n": list(seen.values())})
                seen.clear()
        if seen:
            yield pd.DataFrame({"term": [k[0] for k in seen], "toxic": [k[1] for k in seen], "n": list(seen.values())})

    counts = rows.mapInPandas(counted, "term string, toxic int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("y1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("y0")
    )
    # A term kept needs some toxic documents and a larger share of them than of others; the rest never leaves the executors.
    all_docs = counts.filter("term = ''").collect()
    if not all_docs or not all_docs[0].y1 or not all_docs[0].y0:
        return Model()
    n1, n0 = all_docs[0].y1, all_docs[0].y0
    likely = counts.filter((F.col("term") != "") & (F.col("y1") >= 3) & (F.col("y1") * n0 > 4 * F.col("y0") * n1))
    best = likely.orderBy(F.desc(F.col("y1") / (F.col("y0") + 1)), "term").limit(4 * MAX_TERMS).collect()
    scored = sorted(((z, r.term, d) for r in best for d, z in [log_odds(r.y1, r.y0, n1, n0)] if z >= Z and d >= LEAST_ODDS), key=lambda x: (-x[0], x[1]))
    model = Model(terms={t: d for _, t, d in scored[:MAX_TERMS]}, share=n1 / (n1 + n0))
    if not model.terms:
        return Model()
    terms = model.terms

    def background(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(terms=terms)
        seen: Counter = Counter()
        for b in batches:
            for text, y in zip(b["text"], b["toxic"], strict=True):
                words = words_of(text)
                seen[(y, 0.0)] += len(words)
                seen.update((y, round(s, 2)) for s in map(m.word, words) if s)
        if seen:
            yield pd.DataFrame({"toxic": [k[0] for k in seen], "score": [k[1] for k in seen], "n": list(seen.values())})

    found = rows.mapInPandas(background, "toxic int, score double, n long").groupBy("toxic", "score").agg(F.sum("n").alias("n")).collect()
    n = {y: sum(r.n for r in found if r.toxic == y and r.score == 0) or 1 for y in (0, 1)}
    hits = {y: {r.score: float(r.n) for r in found if r.toxic == y and r.score} for y in (0, 1)}
    typical = float(np.median([r.score for r in found if r.toxic == 1 and r.score > 0] or [1.0]))
    chance = hits[0] or {typical: 0.5}  # half a word where chance gave none
    rate0, rate1 = sum(chance.values()) / n[0], sum(hits[1].values()) / n[1]
    model.neutral = min(-0.02, math.log((1 - min(rate1, 0.5)) / (1 - min(rate0, 0.4))))
    model.decay = _decay(chance, model.neutral, n[0])
    least = min(chance)
    model.rate = min(1.0, rate0 * math.exp(min(model.decay * least, 600)))
    return model


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    @F.pandas_udf(DoubleType())
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([model.score(t) for t in batch], dtype="float64")

    return docs.withColumn(name, scored(F.col("text")))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    out = with_score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
