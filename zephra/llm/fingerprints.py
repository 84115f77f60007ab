"""Document fingerprints by improved consistent weighted sampling (Ioffe, 2010).

A text is a weighted set: its whitespace-separated words with their numbers of occurrences. For each of ``SAMPLES`` slots
every term k has r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1); with t = floor(ln w / r + b) the term of least
ln c - r (t - b) - r is sampled, and (k, t) enters the signature. Two texts agree in a slot with the probability
sum(min w) / sum(max w), the generalised Jaccard similarity. The random numbers come from a table over ``TERMS`` hashed
terms, the same for every process. Terms of one text that share a number count with the larger weight.

Defined results: NULL equals an empty text; a text without a word has the fingerprint of zeros, likeness 1 to another such
text and 0 to any other. Order of documents is doc_id descending, NULL last, equal ids by text. A single document is its own
next one.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zephra.llm.catalog import query, table

TERMS = 1 << 16
SAMPLES = 128
SEED = 20101
_EMPTY = "0" * (4 * SAMPLES)
_CACHE_WORDS = 1 << 18
_CHUNK = 8192
_LEAST = -(1 << 63)


class Sampler:
    """Signatures of texts; one per Python worker, as its tables take some 130 MB."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)

        def gamma2() -> np.ndarray:
            u = -np.log(rng.random((TERMS, SAMPLES), dtype=np.float32) + np.float32(1e-12))
            u -= np.log(rng.random((TERMS, SAMPLES), dtype=np.float32) + np.float32(1e-12))
            return u

        self.r = gamma2()
        self.ln_c = np.log(gamma2())
        self.b = rng.random((TERMS, SAMPLES), dtype=np.float32)
        self.once = self.ln_c + self.r * self.b - self.r  # ln a at weight 1, where t is 0
        self.known: dict[str, int] = {}

    def number(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            if len(self.known) >= _CACHE_WORDS:
                self.known.clear()
            n = self.known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) & (TERMS - 1)
        return n

    def signature(self, text: str) -> np.ndarray | None:
        """One 16-bit hash of (k, t) per slot; None without a word."""
        counts = Counter(text.split())
        if not counts:
            return None
        terms = np.fromiter(map(self.number, counts), dtype=np.int64, count=len(counts))
        weights = np.fromiter(counts.values(), dtype=np.float32, count=len(counts))
        order = np.lexsort((-weights, terms))  # the order of words must not decide between equal samples
        terms, weights = terms[order], weights[order]
        best = np.full(SAMPLES, np.inf, dtype=np.float32)
        which = np.zeros(SAMPLES, dtype=np.int64)
        level = np.zeros(SAMPLES, dtype=np.int64)
        slots = np.arange(SAMPLES)
        one = weights == 1
        for part, single in ((one, True), (~one, False)):
            k_all, w_all = terms[part], weights[part]
            for at in range(0, len(k_all), _CHUNK):
                k = k_all[at : at + _CHUNK]
                if single:
                    ln_a, t = self.once[k], None
                else:
                    r = self.r[k]
                    t = np.floor(np.log(w_all[at : at + _CHUNK])[:, None] / r + self.b[k])
                    ln_a = self.ln_c[k] - r * (t - self.b[k]) - r
                i = ln_a.argmin(axis=0)
                least = ln_a[i, slots]
                win = least < best
                best = np.where(win, least, best)
                which = np.where(win, k[i], which)
                level = np.where(win, 0 if t is None else t[i, slots].astype(np.int64), level)
        mixed = (which * 0x9E3779B1 + level * 0x85EBCA77 + 0x165667B1) & 0xFFFFFFFF
        return (((mixed ^ (mixed >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> 16).astype(">u2")


_worker: list[Sampler] = []


def sampler() -> Sampler:
    if not _worker:
        _worker.append(Sampler())
    return _worker[0]


def as_hex(signature: np.ndarray | None) -> str:
    return _EMPTY if signature is None else signature.tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Share of equal slots."""
    if a is None or b is None:
        return float(a is None and b is None)
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last third replaced by as much of the beginning of ``following``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _cut_points(docs: DataFrame, parts: int) -> list[int]:
    """Ascending distinct quantiles of the ids, ``parts - 1`` at most; one number per future partition."""
    at = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx("_id", at, 10 * parts)).first()[0] if at else None
    return sorted(set(found or []))


def _bucket(cuts: list[int], at: Column) -> Column:
    """Number of cut points above the id: coarse step, then the fine step within it, as arrays hold the cuts."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    starts = F.array(*[F.lit(g[0]) for g in groups])
    arrays = F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups])

    def at_most(cs: Column) -> Column:
        return F.size(F.filter(cs, lambda c: c <= at))

    group = at_most(starts)
    below = F.when(group == 0, 0).otherwise((group - 1) * step + at_most(F.get(arrays, group - 1)))
    return F.lit(len(cuts)) - below


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text, _bucket, _tail, _id) such that each bucket also holds the document after its last one (``_tail`` 1).

    Buckets are ranges of ids, so a document and the next one meet by one shuffle of the texts. Only the first document of
    every bucket travels twice. Cut points and first ids are one number per bucket.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(_LEAST)).alias("_id"))
    ids = docs.select("_id")
    cuts = _cut_points(ids, parts)
    firsts = ids.groupBy(_bucket(cuts, F.col("_id")).alias("b")).agg(F.max("_id").alias("first")).orderBy("b").collect()
    targets = [(firsts[i].first, firsts[i - 1].b) for i in range(len(firsts))]
    own = F.struct(_bucket(cuts, F.col("_id")).alias("_bucket"), F.lit(0).alias("_tail"))
    if not targets:
        return docs.select("doc_id", "text", own.alias("p"), "_id").select("doc_id", "text", "p.*", "_id")
    # One row per bucket, whatever the data: a bounded broadcast.
    heads = docs.sparkSession.createDataFrame(targets, "_id long, _target int")
    copies = F.when(F.col("_target").isNull(), F.array(own)).otherwise(
        F.array(own, F.struct(F.col("_target").alias("_bucket"), F.lit(1).alias("_tail")))
    )
    return docs.join(F.broadcast(heads), "_id", "left").select("doc_id", "text", "_id", F.explode(copies).alias("p")).select(
        "doc_id", "text", "p.*", "_id"
    )


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by bucket, tail, id descending, text; the row before is finished once its successor is seen."""
    s = sampler()
    held = None  # (doc_id, text, signature, bucket)
    for batch in batches:
        rows = []
        for doc_id, text, bucket, tail in zip(batch["doc_id"], batch["text"], batch["_bucket"], batch["_tail"], strict=True):
            if held is not None and held[3] != bucket:
                held = None
            if tail and held is None:
                continue  # a further copy of the tail
            here = s.signature(text)
            if held is not None:
                whole = edited(held[1], text)
                changed = s.signature(whole)
                rows.append((
                    held[0], len(held[1]), hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest(), as_hex(held[2]), as_hex(changed),
                    likeness(held[2], changed), likeness(held[2], here),
                ))
            held = None if tail else (doc_id, text, here, bucket)
        out = pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        yield out.astype({"doc_id": "Int64", "n_chars": "int64", "near_edited": "float64", "near_next": "float64"})


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness to each other and to the next document's."""
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, parts).repartition(parts, "_bucket").sortWithinPartitions("_bucket", "_tail", F.desc("_id"), "text")
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double,"
        " near_next double"
    )
    return rows.select("doc_id", "text", "_bucket", "_tail").mapInPandas(_compare, schema)


@query("op2_fingerprints")
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(table(spark, sf_dir, "documents"))
