"""Importance resampling towards a target: hashed n-gram features, log ratios of smoothed counts, Gumbel top-k.

Texts are taken in batches of about ``BATCH_BYTES``: a batch is joined with a line feed, which no word can hold, between its
texts; one regular expression finds the words of all of them; ``searchsorted`` on the texts' offsets tells the text of each
word, and a run of words counts only if its first and last word lie in the same text. Checksums of runs are combined from
those of their words, so no run is ever written out; a ``bincount`` of their buckets ends the batch. A task sends one count
per bucket. The ratios of the ``BUCKETS`` buckets go to the tasks of the second pass, which weigh every text the same way.

Rows are drawn by the greatest weight plus Gumbel noise, which depends on doc_id alone. They are numbered by ranges, without
gathering them in one task.

Defined results: NULL equals an empty text: no words, no features, weight 0. A NULL doc_id is hashed as an empty one and comes
last among equal scores. Repeated rows are separate rows of the draw. An empty table gives no rows; an empty target has no counts
(every ratio is that of the smoothing). A batch holds whole texts, so memory follows ``BATCH_BYTES`` or the longest text.
Only ``doc_id`` and the text column are read; other columns do not take part.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zephra.llm.catalog import query, table
from zephra.scale import cut_lineage, ranked

BUCKETS = 10_000
MAX_RUN = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
BATCH_BYTES = 1 << 20
#: In bytes as in characters: every byte of a sign beyond ASCII belongs to a word.
_WORD = re.compile(rb"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)")
_TABLED = 64  # words of up to so many bytes are appended by table


def _append_tables() -> np.ndarray:
    """[n, k, b]: what byte k of a checksum, if b, becomes when n bytes follow; checksums are linear in their bits."""
    one = np.array([zlib.crc32(bytes(1), b) ^ zlib.crc32(bytes(1)) for b in range(256)], dtype=np.uint32)
    tables = np.empty((_TABLED + 1, 4, 256), dtype=np.uint32)
    for k in range(4):
        tables[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, _TABLED + 1):
        last = tables[n - 1]
        tables[n] = one[last & np.uint32(255)] ^ (last >> np.uint32(8))
    return tables


_APPEND = _append_tables()
_SPACE = np.uint32(zlib.crc32(b" "))


def appended(first: np.ndarray, words: list[bytes], sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksums of texts with checksums ``first``, each followed by a space and the word beside it."""
    n = np.minimum(sizes, _TABLED)
    left = _APPEND[1, 0, first & 255] ^ _APPEND[1, 1, (first >> 8) & 255] ^ _APPEND[1, 2, (first >> 16) & 255] ^ _APPEND[1, 3, first >> 24] ^ _SPACE
    out = _APPEND[n, 0, left & 255] ^ _APPEND[n, 1, (left >> 8) & 255] ^ _APPEND[n, 2, (left >> 16) & 255] ^ _APPEND[n, 3, left >> 24] ^ sums
    for i in np.flatnonzero(sizes > _TABLED):
        out[i] = zlib.crc32(words[i], int(left[i]))
    return out


def batch_features(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of words per text, bucket of every feature, text of every feature)."""
    parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    offsets = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
    pieces = _WORD.split(b"\n".join(parts))  # gap, word, gap, ..., word, gap
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    words = pieces[1::2]
    n = len(words)
    text = np.searchsorted(offsets, ends[0:-1:2][:n], side="right") - 1
    sizes = ends[1::2] - ends[0:-1:2]
    sums = np.fromiter(map(zlib.crc32, words), np.uint32, n)
    runs, found, where = sums, [sums], [text]
    for k in range(1, min(MAX_RUN, n)):
        runs = appended(runs[:-1], words[k:], sums[k:], sizes[k:])
        inside = text[k:] == text[:-k]
        found.append(runs[inside])
        where.append(text[k:][inside])
    return np.bincount(text, minlength=len(parts)), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), np.concatenate(where)


def _batches(texts: pd.Series) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of whole texts of about ``BATCH_BYTES`` with the place of their first."""
    first, part, size = 0, [], 0
    for i, t in enumerate(texts):
        if part and size + len(t or "") > BATCH_BYTES:
            yield first, part
            first, part, size = i, [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield first, part


def bucket_counts(rows: DataFrame, text: str = "text") -> np.ndarray:
    """Features per bucket over all rows."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for frame in frames:
            for _, part in _batches(frame["_t"]):
                total += np.bincount(batch_features(part)[1], minlength=BUCKETS)
        if len(filled := np.flatnonzero(total)):
            yield pd.DataFrame({"bucket": filled, "n": total[filled]})

    sums = rows.select(F.col(f"`{text}`").alias("_t")).mapInPandas(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, rounded down."""
    of_target, of_corpus = int(target.sum()) + len(target), int(corpus.sum()) + len(corpus)
    return np.array([math.floor(1000 * math.log(((int(t) + 1) * of_corpus) / ((int(s) + 1) * of_target))) for t, s in zip(target, corpus, strict=True)])


def weighted(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    worth = gain.astype(np.float64)  # sums of whole numbers, exact below 2**53

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weighed(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in columns:
            words, features, weight = (np.zeros(len(column), dtype=np.int64) for _ in range(3))
            for first, part in _batches(column):
                at = slice(first, first + len(part))
                words[at], bucket, where = batch_features(part)
                features[at] = np.bincount(where, minlength=len(part))
                weight[at] = np.bincount(where, weights=worth[bucket], minlength=len(part)).astype(np.int64)
            yield pd.DataFrame({"n_words": words, "n_features": features, "weight": weight})

    return docs.select("doc_id", weighed(F.col(f"`{text}`")).alias("_w")).select("doc_id", "_w.*")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every row's (doc_id, n_words, n_features, weight, score, rank); rank is NULL for rows that are not drawn."""
    rows = weighted(docs, gains(bucket_counts(target), bucket_counts(docs)))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = cut_lineage(rows.withColumn("score", (F.col("weight") + noise).cast("long")))
    eligible = F.col("n_words") >= least_words
    n = rows.filter(eligible).count()
    order = rows.filter(eligible).withColumns({"_down": -F.col("score"), "_none": F.col("doc_id").isNull()})
    placed = ranked(order, [], ["_down", "_none", "doc_id", "n_features"], "_place")
    drawn = F.when(F.col("_place") <= percent * n // 100, F.col("_place").cast("long"))
    return placed.withColumn("rank", drawn).select(*rows.columns, "rank").unionByName(
        rows.filter(~eligible).withColumn("rank", F.lit(None).cast("long"))
    )


@query("op11_resampling")
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = resample(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
