"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

A text is lower-cased and every run of signs that are no letters becomes one space; runs of 1 to ``MAX_GRAM`` characters are
hashed to ``DIMS`` features. Document frequencies are counted over all documents to learn from. The regression is trained by
follow-the-regularised-leader with an elastic-net penalty (most weights end at zero) on at most ``MAX_LABELLED`` labelled
documents, drawn by a hash so that languages get equal numbers where they have as many; they meet in one task, as features.
Every fourth of them is kept out of the training and fits the temperature by which the scores are divided before the softmax.

Defined results: a text that is NULL or has no letter is ``UNKNOWN`` with score 0, and so is every text if there is nothing to
learn from. With a single language every other text has it, with score 1. Equal scores go to the first language by name. Each
row is predicted by itself, from its text alone, the whole of it; a very long text is read in pieces of ``PIECE`` characters, so
memory does not follow its length. Only doc_id, text and lang are read; other columns do not take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zephra.llm.catalog import query, table

DIMS = 1 << 15
MAX_GRAM = 3
MAX_LABELLED = 4000
_SENT = 256  # rows of features in a frame
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
PIECE = 1 << 16
UNKNOWN = "und"
CALIBRATED = 4  # every so many-th document fits the temperature
_STEP = np.uint32(0x9E3779B1)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def counts(text: str) -> np.ndarray:
    """Occurrences per feature of a whole text; all zero without a letter."""
    total = np.zeros(DIMS, dtype=np.int64)
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(f" {text[at : at + PIECE + MAX_GRAM - 1].lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[codes]
        if not letter.any():
            continue
        first = letter.copy()  # of a run of other signs, or a letter
        first[1:] |= letter[:-1]
        first[0] = True
        codes = np.where(letter, codes, np.uint32(32))[first] * _STEP
        h = np.zeros(len(codes), dtype=np.uint32)
        for n in range(MAX_GRAM):
            h = h[: len(codes) - n]
            h = (h ^ (h >> np.uint32(15))) * _STEP + codes[n:] + np.uint32(n + 1)
            total += np.bincount((h * _STEP) >> np.uint32(17), minlength=DIMS)
    return total


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(features, weights of length 1) of a text; None without a letter."""
    tf = counts(text or "")
    idx = np.flatnonzero(tf > 0)
    if not len(idx):
        return None
    x = (1.0 + np.log(tf[idx])) * idf[idx]
    return idx, x / np.sqrt((x * x).sum())


def held_out(key: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % parts == part, F.lit(False))


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_weights(rows: list[tuple[int, np.ndarray, np.ndarray]], n_classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """(DIMS + 1) x classes weights, the last row the intercepts, after ``epochs`` passes in the given order."""
    z = np.zeros((DIMS + 1, n_classes))
    n = np.zeros((DIMS + 1, n_classes))

    def weights(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0.0, (np.sign(z[at]) * L1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for label, idx, x in rows:
            at, v = np.append(idx, DIMS), np.append(x, 1.0)
            w = weights(at)
            p = _softmax(v @ w)
            p[label] -= 1.0
            g = v[:, None] * p[None, :]
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
            n[at] = more
    return weights(np.arange(DIMS + 1))


def fit_temperature(logits: np.ndarray, y: np.ndarray, low: float = 0.02, high: float = 20.0) -> float:
    """The divisor of least log loss between ``low`` and ``high``, by golden section over its logarithm; 1 without rows."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / math.exp(t)
        top = s.max(axis=1)
        return float((top + np.log(np.exp(s - top[:, None]).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    a, b, r = math.log(low), math.log(high), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return math.exp((a + b) / 2)


class Model:
    """Languages by name, inverse document frequencies, weights and temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float) -> None:
        self.languages, self.temperature = languages, temperature
        self.idf = idf.astype(np.float32)
        self.used = np.flatnonzero(weights.any(axis=1))  # the others are zero for all languages and need not travel
        self.values = weights[self.used]

    def weights(self) -> np.ndarray:
        w = np.zeros((DIMS + 1, len(self.languages)))
        w[self.used] = self.values
        return w


def inverse_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Smoothed log of documents over documents holding the feature, over all rows with a letter."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(DIMS + 1, dtype=np.int64)
        for frame in frames:
            for t in frame["_t"]:
                found = counts(t or "") > 0
                total[:DIMS] += found
                total[DIMS] += found.any()
        if total[DIMS]:
            filled = np.flatnonzero(total)
            yield pd.DataFrame({"feature": filled, "n": total[filled]})

    total = np.zeros(DIMS + 1)
    sums = docs.select(F.col(f"`{text}`").alias("_t")).mapInPandas(counted, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    for r in sums.collect():
        total[r["feature"]] = r["n"]
    return np.log((1.0 + total[DIMS]) / (1.0 + total[:DIMS])) + 1.0


def fit(docs: DataFrame, lang: str = "lang", max_labelled: int = MAX_LABELLED) -> Model | None:
    """Model from the rows of ``docs`` with a language; None if there are none."""
    known = docs.select("doc_id", "text", F.col(f"`{lang}`").alias("_lang")).filter(F.col("_lang").isNotNull())
    sizes = {r["_lang"]: r["n"] for r in known.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    idf = inverse_frequencies(known)
    # A hash below the share drawn of its language; the least hashes then bound the number, whatever is repeated.
    share = F.create_map(*[x for name, n in sizes.items() for x in (F.lit(name), F.lit(min(1.0, max_labelled / len(sizes) / n)))])
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit("draw"))
    some = known.select("_lang", "text", draw.alias("_h")).filter(F.pmod("_h", F.lit(1 << 30)) < F.element_at(share, F.col("_lang")) * (1 << 30))
    number = {name: k for k, name in enumerate(languages)}

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), _SENT):
                part = frame.iloc[at : at + _SENT]
                found = [(h, number[n], v) for h, n, t in zip(part["_h"], part["_lang"], part["text"], strict=True) if (v := vector(t, idf))]
                if found:
                    h, label, v = zip(*found, strict=True)
                    yield pd.DataFrame({"h": h, "label": label, "idx": [i.astype(np.int32) for i, _ in v], "val": [x.astype(np.float32) for _, x in v]})

    def fitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [
            (h, int(y), np.asarray(i, dtype=np.int64), np.asarray(v, dtype=np.float64))
            for f in frames
            for h, y, i, v in zip(f["h"], f["label"], f["idx"], f["val"], strict=True)
        ]
        rows.sort(key=lambda r: (r[0], r[1], len(r[2]), r[3].tobytes()))
        apart = rows[CALIBRATED - 1 :: CALIBRATED]
        w = fit_weights([r[1:] for i, r in enumerate(rows) if i % CALIBRATED != CALIBRATED - 1], len(languages))
        logits = np.array([v @ w[i] + w[DIMS] for _, _, i, v in apart]).reshape(-1, len(languages))
        t = fit_temperature(logits, np.array([y for _, y, _, _ in apart], dtype=np.int64))
        if rows:
            yield pd.DataFrame({"temperature": [t], "used": [np.flatnonzero(w.any(axis=1)).tolist()], "value": [w[w.any(axis=1)].ravel().tolist()]})

    rows = some.mapInPandas(made, "h long, label int, idx array<int>, val array<float>")
    rows = rows.orderBy("h", "label", "idx", "val").limit(max_labelled)
    out = rows.mapInPandas(fitted, "temperature double, used array<int>, value array<double>").collect()
    if not out:
        return None
    out, weights = out[0], np.zeros((DIMS + 1, len(languages)))
    weights[out["used"]] = np.array(out["value"]).reshape(-1, len(languages))
    return Model(languages, idf, weights, out["temperature"])


def with_language(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})

    @F.pandas_udf("lang_pred string, score double")
    def predicted(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w = model.weights()
        for column in columns:
            names, scores = [], []
            for t in column:
                found = vector(t, model.idf)
                if found is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = _softmax((found[1] @ w[found[0]] + w[DIMS]) / model.temperature)
                k = int(p.argmax())
                names.append(model.languages[k])
                scores.append(float(p[k]))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), predicted(F.col(f"`{text}`")).alias("_found"))
    return found.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("lang_pred", "score")], "_found.lang_pred", "_found.score")


@query("op12_language")
def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return with_language(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
