"""Quality classifier: ordinal regression with cumulative links on graded ratings.

P(grade <= k) = sigmoid(theta_k - w.x) with one weight vector shared by all grades and ordered thresholds theta. x holds
hashed features of the whole text: the shapes of its words (letters, digits and signs collapsed) by share, and how much of
it is repeated (distinct words, distinct word pairs, distinct lines) by level. Documents get the expected grade and the
probability of at least a given grade, by which they are selected.

The fit takes ``MAX_RATED`` rated documents at most (those of least hash of doc_id), in one task; features are made where the
texts are. Scores use whole texts and no label.

Defined results: NULL equals an empty text, scored by its features like any other. Ratings that are NULL or belong to no
document are left out; with no rating at all, nothing is known and everything is kept (tail probability 1, expected grade
NULL). With a single grade every document has that grade.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from zephra.llm.catalog import query, table

DIMS = 1 << 12
MAX_RATED = 8000
STEPS = 400
RATE = 0.1
RIDGE = 1e-4
KEEP_TAIL = 0.5
_CACHE_WORDS = 1 << 18
_SHAPES = [(re.compile(r"[^\W\d_]+"), ""), (re.compile(r"\d+"), "9"), (re.compile(r"(.)\1+"), r"\1")]
_FEATURES = StructType([StructField("idx", ArrayType(IntegerType())), StructField("val", ArrayType(FloatType()))])
_known: dict[str, int] = {}


def _number(name: str) -> int:
    return xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass")) & (DIMS - 1)


def _letters(run: re.Match) -> str:
    s = run[0]
    return "A" if len(s) > 1 and s.isupper() else "I" if s[0].isupper() else "a"


def _shape(word: str) -> int:
    n = _known.get(word)
    if n is None:
        if len(_known) >= _CACHE_WORDS:
            _known.clear()
        s = _SHAPES[0][0].sub(_letters, word)
        s = _SHAPES[2][0].sub(r"\1", _SHAPES[1][0].sub("9", s))
        n = _known[word] = _number("shape " + s)
    return n


def _level(name: str, part: int, whole: int) -> list[int]:
    """One indicator per tenth reached."""
    return [_number(f"{name} {k}") for k in range(1, int(10 * part / max(1, whole)) + 1)]


def features(text: str | None) -> tuple[list[int], list[float]]:
    """Numbers and values of the features of a text."""
    words = (text or "").split()
    n = len(words)
    counts = Counter(map(_shape, words))
    found = {k: (c / n) ** 0.5 for k, c in counts.items()}
    lines = [x for x in (text or "").split("\n") if x]
    levels = (
        _level("words", len(set(words)), n)
        + _level("pairs", len(set(zip(words, words[1:]))), max(1, n - 1))
        + _level("lines", len(set(lines)), len(lines))
        + [_number(f"size {k}") for k in range(n.bit_length())]
    )
    for k in levels:
        found[k] = found.get(k, 0.0) + 0.3
    return list(found), list(found.values())


@F.pandas_udf(_FEATURES)
def _features(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        made = [features(t) for t in batch]
        yield pd.DataFrame({"idx": [m[0] for m in made], "val": [m[1] for m in made]})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: list[tuple[int, list[int], list[float]]], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grades, thresholds, weights) of greatest penalised likelihood, by Adam over all rows.

    Thresholds are a first one and positive steps, so they stay in order.
    """
    grades, y = np.unique([r[0] for r in rows], return_inverse=True)
    if len(grades) < 2:
        return grades.astype(float), np.zeros(0), np.zeros(DIMS)
    where = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    idx = np.concatenate([np.asarray(r[1], dtype=np.int64) for r in rows])
    val = np.concatenate([np.asarray(r[2], dtype=np.float64) for r in rows])
    k = len(grades) - 1
    share = np.cumsum(np.bincount(y, minlength=k + 1))[:k] / len(y)
    theta = np.log(share / (1 - share))
    par = np.concatenate([[theta[0]], np.log(np.maximum(np.diff(theta), 1e-3)), np.zeros(DIMS)])
    m, v = np.zeros_like(par), np.zeros_like(par)
    row = np.arange(len(y))
    for t in range(1, steps + 1):
        theta = par[0] + np.concatenate([[0.0], np.cumsum(np.exp(par[1:k]))])
        w = par[k:]
        s = np.bincount(where, weights=val * w[idx], minlength=len(y))
        cum = np.concatenate([np.zeros((len(y), 1)), _sigmoid(theta[None, :] - s[:, None]), np.ones((len(y), 1))], axis=1)
        slope = cum * (1 - cum)
        p = np.maximum(cum[row, y + 1] - cum[row, y], 1e-9)
        # d log p / d theta_j is nonzero for the thresholds on either side of the grade.
        g_theta = np.bincount(y, weights=slope[row, y + 1] / p, minlength=k + 1)[:k] - np.bincount(y, weights=slope[row, y] / p, minlength=k + 1)[1:]
        g_s = -(slope[row, y + 1] - slope[row, y]) / p
        g_w = np.bincount(idx, weights=val * g_s[where], minlength=DIMS)
        tail = np.cumsum(g_theta[::-1])[::-1]
        grad = np.concatenate([[tail[0]], tail[1:] * np.exp(par[1:k]), g_w]) / len(y)
        grad[k:] -= RIDGE * w
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        par = par + RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    theta = par[0] + np.concatenate([[0.0], np.cumsum(np.exp(par[1:k]))])
    return grades.astype(float), theta, par[k:]


def fit(docs: DataFrame, ratings: DataFrame, grade: str = "quality", max_rated: int = MAX_RATED) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Model from a bounded number of rated documents; None without any."""
    rated = ratings.select("doc_id", F.col(f"`{grade}`").cast("int").alias("grade")).dropna()
    some = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(max_rated)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("grade", _features("text").alias("f"))

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [r for b in batches for r in zip(b["grade"].tolist(), b["idx"].tolist(), b["val"].tolist(), strict=True)]
        if seen:
            yield pd.DataFrame({"part": [0, 1, 2], "values": [a.tolist() for a in fit_ordinal(seen)]})

    model = rows.select("grade", "f.idx", "f.val").repartition(1).mapInPandas(fitted, "part int, values array<double>").collect()
    if not model:
        return None
    by = {r["part"]: np.array(r["values"], dtype=float) for r in model}
    return by[0], by[1], by[2]


def with_grade(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray] | None, least: float | None = None) -> DataFrame:
    """``docs`` with expected_grade and tail_probability, that of at least the grade ``least`` (the highest one if None)."""
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(None).cast("double"), "tail_probability": F.lit(1.0)})
    grades, theta, w = model
    bar = grades[-1] if least is None else least
    schema = StructType([StructField("expected", DoubleType()), StructField("tail", DoubleType())])

    @F.pandas_udf(schema)
    def graded(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            s = np.zeros(len(batch))
            for i, t in enumerate(batch):
                idx, val = features(t)
                s[i] = float(np.dot(w[idx], val)) if idx else 0.0
            cum = np.concatenate([_sigmoid(theta[None, :] - s[:, None]), np.ones((len(s), 1))], axis=1)
            p = np.diff(np.concatenate([np.zeros((len(s), 1)), cum], axis=1), axis=1)
            yield pd.DataFrame({"expected": p @ grades, "tail": p[:, grades >= bar].sum(axis=1)})

    scored: Column = F.col("_grade")
    out = docs.withColumn("_grade", graded(F.col("text")))
    return out.withColumns({"expected_grade": scored["expected"], "tail_probability": scored["tail"]}).drop("_grade")


def select_documents(docs: DataFrame, model, keep: float = KEEP_TAIL, least: float | None = None) -> DataFrame:
    """Rows of ``docs`` whose tail probability reaches ``keep``; their columns only."""
    marked = with_grade(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text"), model, least)
    return marked.filter(F.col("tail_probability") >= keep).select("_row.*")


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_grade(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= KEEP_TAIL).alias("keep"))
