"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64 majority bits over the XXH64 (seed 42) of a text's word shingles. To find all pairs of at most ``tau``
differing bits, the bits are divided into m groups with thresholds t_i >= -1 and sum(t_i + 1) = tau + 1: such a pair then
differs in at most t_i bits in at least one group i (a group of threshold -1 is not probed). Correlated bits go to the same
group; a dynamic programme chooses the thresholds from the candidate counts expected of each group and threshold, and m is
the number of groups with the cheapest choice. Every fingerprint is probed in each group under all values within t_i bits;
pairs that meet are verified by their whole distance. The plan changes cost only, never the result.

Work is done on distinct fingerprints, so exact copies cost one row. A bucket of more than ``BUCKET`` fingerprints is
divided again by the pigeonhole principle over its remaining bits, so a large group of near copies is not compared pair by
pair in one place.

Defined results: NULL equals an empty text, whose fingerprint is zero and links like any other. A NULL doc_id counts as
larger than any number; a group of only such rows has a NULL component_id. Repeated rows share their component.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from zephra.llm.catalog import query, table
from zephra.operators.components import components
from zephra.scale import cut_lineage, merged_if_large

BITS = 64
SHINGLE = 4
MAX_DISTANCE = 4
BUCKET = 2048
SAMPLE = 4096  # fingerprints that the candidate counts are estimated from
GROUPS = (2, 3, 4, 5)
_WORDS = re.compile("[^\x20\x09-\x0d]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_CHUNK = 1 << 14


def simhash(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint; a text of fewer words is one shingle, one without words has 0."""
    words = _WORDS.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        hashes = [
            xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode("utf-8", "surrogatepass"), 42)
            for i in range(at, min(n, at + _CHUNK))
        ]
        ones += np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprint_of(text: str, width: int = SHINGLE) -> Column:
    """Fingerprint column (as a signed long) of the text column."""

    @F.pandas_udf(LongType())
    def made(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([simhash(t, width) for t in batch], dtype=np.uint64).view(np.int64))

    return made(F.col(f"`{text}`"))


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def bit_statistics(nodes: DataFrame, sample: int = SAMPLE) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, 64 x 64 correlations of their bits over all of them, and a hash-ordered sample."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS), dtype=np.int64)
        n = 0
        for b in batches:
            bits = np.unpackbits(b["fp"].to_numpy(np.int64).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
            n += len(bits)
        yield pd.DataFrame({"i": np.arange(BITS * BITS + 1), "c": np.append(total.ravel(), n)})

    sums = nodes.select("fp").mapInPandas(counted, "i int, c long").groupBy("i").agg(F.sum("c").alias("c")).toPandas()
    both = np.zeros(BITS * BITS + 1, dtype=np.float64)
    both[sums["i"].to_numpy()] = sums["c"].to_numpy()
    n = int(both[-1])
    joint = both[:-1].reshape(BITS, BITS) / max(1, n)
    p = np.diag(joint)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    picked = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    return n, np.abs((joint - np.outer(p, p)) / np.outer(sd, sd)), picked


def bit_groups(corr: np.ndarray, m: int) -> list[int]:
    """m masks of nearly equal size; each grows by the free bit most correlated with it."""
    free = set(range(BITS))
    masks = []
    for g in range(m):
        size = (BITS - sum(bin(x).count("1") for x in masks)) // (m - g)
        start = max(sorted(free), key=lambda b: sum(corr[b, c] for c in free) - corr[b, b])
        group = [start]
        free.remove(start)
        while len(group) < size:
            add = max(sorted(free), key=lambda b: sum(corr[b, c] for c in group))
            group.append(add)
            free.remove(add)
        masks.append(sum(1 << (BITS - 1 - b) for b in group))  # bit 0 of unpackbits is the highest
    return masks


def _signatures(width: int, t: int) -> int:
    out, c = 0, 1
    for k in range(t + 1):
        out += c
        c = c * (width - k) // (k + 1)
    return out


def expected_costs(masks: list[int], n: int, picked: np.ndarray, tau: int) -> list[list[float]]:
    """Per group and threshold -1 .. tau: probes plus candidate pairs expected of n fingerprints.

    Pairs are estimated from those of the sample, with half a pair where none is found, and never below random bits.
    """
    pairs = max(1, len(picked) * (len(picked) - 1) // 2)
    out = []
    for mask in masks:
        width = bin(mask).count("1")
        seen = np.zeros(tau + 1)
        for at in range(0, len(picked), 256):
            block = picked[at : at + 256, None] ^ picked[None, :]
            later = np.arange(len(picked))[None, :] > np.arange(at, min(at + 256, len(picked)))[:, None]
            d = np.bitwise_count(block & np.uint64(mask))[later]
            seen += np.bincount(d[d <= tau], minlength=tau + 1)[: tau + 1]
        near = np.cumsum(seen)
        row = [0.0]
        for t in range(tau + 1):
            share = max(near[t], 0.5 * (near[t] == 0)) / pairs if pairs > 1 else 0.0
            uniform = _signatures(width, t) / 2.0**width
            share = max(share if near[t] >= 5 else min(share, 4 * uniform), uniform)
            row.append(n * _signatures(width, t) + share * n * n / 2)
        out.append(row)
    return out


def allocate(costs: list[list[float]], tau: int) -> tuple[float, list[int]]:
    """Thresholds with sum(t_i + 1) = tau + 1 of least total cost; ``costs[i][t + 1]`` is that of t in group i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for units in range(0, tau + 2 - used):
                made = (cost + row[units], [*ts, units - 1])
                if used + units not in step or made[0] < step[used + units][0]:
                    step[used + units] = made
        best = step
    return best[tau + 1]


def make_plan(nodes: DataFrame, tau: int) -> list[tuple[int, int]]:
    """(mask, threshold) of the groups to probe."""
    n, corr, picked = bit_statistics(nodes)
    choices = []
    for m in GROUPS:
        masks = bit_groups(corr, m)
        cost, ts = allocate(expected_costs(masks, n, picked, tau), tau)
        choices.append((cost, [(k, t) for k, t in zip(masks, ts, strict=True) if t >= 0]))
    return min(choices, key=lambda c: c[0])[1]


def _flips(mask: int, t: int) -> list[int]:
    bits = [1 << b for b in range(BITS) if mask >> b & 1]
    return [signed(sum(c)) for k in range(t + 1) for c in combinations(bits, k)]


def _keyed(nodes: DataFrame, plan: list[tuple[int, int]], probe: bool) -> DataFrame:
    """(part, key, fp): the value of each probed group, or all values within its threshold."""

    def values(i: int, mask: int, t: int) -> Column:
        own = F.col("fp").bitwiseAND(F.lit(signed(mask)))
        flips = F.array(*[F.lit(x).cast("long") for x in (_flips(mask, t) if probe else [0])])
        return F.transform(flips, lambda x: F.struct(F.lit(i).alias("part"), own.bitwiseXOR(x).alias("key")))

    parts = [values(i, mask, t) for i, (mask, t) in enumerate(plan)]
    return nodes.select("fp", F.explode(F.concat(*parts)).alias("k")).select("k.part", "k.key", "fp")


def _subdivided(rows: DataFrame, hot: DataFrame, plan: list[tuple[int, int]], tau: int) -> DataFrame:
    """Rows of crowded buckets once per block of the bits outside their group: tau + 1 blocks, one of which must agree."""
    whole = F.array(F.struct(F.lit(-1).alias("block"), F.lit(0).cast("long").alias("sub")))
    blocks = F.lit(None)
    for i, (mask, _) in enumerate(plan):
        rest = [b for b in range(BITS) if not mask >> b & 1]
        subs = [sum(1 << b for b in rest[j :: tau + 1]) for j in range(tau + 1)]
        made = F.array(*[
            F.struct(F.lit(j).alias("block"), F.col("fp").bitwiseAND(F.lit(signed(s))).alias("sub")) for j, s in enumerate(subs)
        ])
        blocks = made if i == 0 else F.when(F.col("part") == i, made).otherwise(blocks)
    marked = rows.join(hot.withColumn("hot", F.lit(True)), ["part", "key"], "left")
    return marked.select("part", "key", "fp", F.explode(F.when(F.col("hot"), blocks).otherwise(whole)).alias("b")).select(
        "part", "key", "fp", "b.block", "b.sub"
    )


def links(nodes: DataFrame, tau: int = MAX_DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(u, v) for all pairs u < v of distinct fingerprints (column ``fp``) at most ``tau`` bits apart; pairs may repeat."""
    plan = make_plan(nodes, tau)
    index, probes, on = _keyed(nodes, plan, False), _keyed(nodes, plan, True), ["part", "key"]
    hot = cut_lineage(index.groupBy("part", "key").count().filter(F.col("count") > bucket).select("part", "key"))
    if not hot.isEmpty():
        index, probes = _subdivided(index, hot, plan, tau), _subdivided(probes, hot, plan, tau)
        on = [*on, "block", "sub"]
    # Catalyst takes an explode to be as large as the fingerprints, and would broadcast all probes of some million of them.
    a, b = index.withColumnRenamed("fp", "u"), probes.withColumnRenamed("fp", "v").hint("merge")
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= tau)
    same = F.lit(True)
    for c in on:
        same = same & (a[c] == b[c])
    return a.join(b, same & near).select("u", "v")


def grouped(docs: DataFrame, width: int = SHINGLE, tau: int = MAX_DISTANCE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of all documents, and (fp, component_id, keep_fp) of all distinct fingerprints.

    ``component_id`` is the smallest doc_id of the component, ``keep_fp`` the (least) fingerprint under which it occurs.
    """
    prints = merged_if_large(cut_lineage(docs.select("doc_id", fingerprint_of("text", width).alias("fp"))))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = links(nodes, tau).select(F.lit(0).alias("run"), "u", "v")
    labels = components(edges).select(F.col("u").alias("fp"), "label")
    placed = merged_if_large(nodes).join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = placed.groupBy("label").agg(F.min("least").alias("component_id"), F.min(F.struct(F.col("least").isNull(), "least", "fp")).alias("first"))
    least = least.select("label", "component_id", F.col("first.fp").alias("keep_fp"))
    return prints, placed.join(least, "label").select("fp", "component_id", "keep_fp")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, tau: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``."""
    prints, placed = grouped(docs, width, tau)
    return prints.join(placed, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, width: int = SHINGLE, tau: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with the document of smallest doc_id of every group; one row where it is repeated."""
    prints, placed = grouped(docs, width, tau)
    keep = placed.filter(F.col("fp") == F.col("keep_fp")).select("fp", F.col("component_id").alias("_keep"))
    chosen = prints.join(keep, (prints["fp"] == keep["fp"]) & prints["doc_id"].eqNullSafe(keep["_keep"])).select("_keep", prints["fp"].alias("_fp"))
    chosen = merged_if_large(cut_lineage(chosen.distinct()), 500_000)
    # An id with several texts must be matched by fingerprint too; ids are normally unique, so that step is mostly empty.
    several = cut_lineage(prints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("doc_id"))
    if several.isEmpty():
        return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["_keep"]), "left_semi")
    marked = docs.withColumn("_fp", fingerprint_of("text", width))
    picked = marked.join(chosen.select("_keep", F.col("_fp").alias("_kfp")), marked["doc_id"].eqNullSafe(F.col("_keep")) & (F.col("_fp") == F.col("_kfp")), "left_semi")
    return picked.dropDuplicates(["doc_id", "_fp"]).drop("_fp")


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
