"""Importance resampling, language identification and centroid clustering, held against brute force and held-out rows: 11, 12, 13."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from zephra.llm import centroids, importance, language

SF = "/root/testdata/sf0.01"
WORDS = "ash birch cedar dogwood elm fir ginkgo hazel ivy juniper kauri larch maple nutmeg oak pine quince rowan spruce teak".split()


def ngrams(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


# 11 --------------------------------------------------------------------------------------------------------------------


def brute_draw(docs, target):
    grams = [ngrams(t) for _, t in docs]
    s, t = Counter(b for _, g in grams for b in g), Counter(b for x in target for b in ngrams(x)[1])
    big_s, big_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    rows = []
    for (doc_id, _), (n, g) in zip(docs, grams):
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in g)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in rows), key=repr)


def test_resampling_equals_brute_force_on_odd_texts(spark):
    texts = [None, "", "\x00 -- \n", "É" * 70 + " x " + "q" * 300 + " y", "AbC aBc", *[" ".join(WORDS[(i * k + k * k) % 20] for k in range(i % 45)) for i in range(300)]]
    texts += ["Zebra 12 été, " * 30] * 60
    docs = [(i if i != 7 else None, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(i, t, 1, 2.0, "x") for i, t in docs], "doc_id long, text string, weight int, score double, n_words string")
    target = spark.createDataFrame([("a", "ash birch cedar été zebra"), ("b", None), ("c", "12 été")], "item_id string, text string")
    got = importance.resample(frame.repartition(5), target)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    rows = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=repr)
    assert rows == brute_draw(docs, ["ash birch cedar été zebra", None, "12 été"])
    assert importance.resample(frame.limit(0), target).collect() == []
    assert importance.resample(frame, target.limit(0)).filter("rank = 1").count() == 1


def test_resampling_equals_brute_force_on_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = importance.op11_resampling(spark, SF).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_draw(docs, target)


def test_runs_do_not_cross_texts_in_a_batch():
    texts = ["a b", "c", "", None, "d e f g"]
    n, bucket, where = importance.batch_features(texts)
    assert n.tolist() == [2, 1, 0, 0, 4]
    for i, t in enumerate(texts):
        assert sorted(bucket[where == i].tolist()) == sorted(ngrams(t)[1])


def test_repeated_rows_are_drawn_separately(spark):
    rows = [(1, " ".join(WORDS))] * 40
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("ash",)], "text string"))
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == [1, 2]


# 12 --------------------------------------------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.op12_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    tested = [r for r in got if r.held_out]
    right = [r.lang == r.lang_pred for r in tested]
    assert np.mean(right) >= 0.98 and {r.lang_pred for r in got} <= {"en", "de", "fr", "es"}
    assert abs(np.mean([r.score for r in tested]) - np.mean(right)) < 0.05


def test_language_edge_cases(spark):
    rows = [(i, t, g, "clash", 0.5) for i in range(60) for t, g in (("the rain and the wind", "en"), ("der wind und das haus", "de"))]
    rows += [(900, None, "en", "c", 0.1), (901, "12 -- !", "de", "c", 0.1), (902, "the rain", None, "c", 0.1), (None, "der wind", None, "c", 0.1), (903, "das haus " * 40_000, None, "c", 0.2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    model = language.fit(docs.filter(~language.held_out()))
    got = language.with_language(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    by = {r.doc_id: r for r in got.filter("doc_id >= 900 or doc_id is null").collect()}
    assert [by[k].lang_pred for k in (900, 901, 902, None, 903)] == ["und", "und", "en", "de", "de"]
    assert by[900].score == 0.0 and 0.5 < by[902].score <= 1.0
    assert language.fit(docs.limit(0)) is None and language.fit(docs.filter("lang is null")) is None
    assert {tuple(r) for r in language.with_language(docs, None).select("lang_pred", "score").distinct().collect()} == {("und", 0.0)}
    alone = language.fit(docs.filter("lang = 'en'"))
    assert {tuple(r) for r in language.with_language(docs.limit(5), alone).select("lang_pred", "score").collect()} == {("en", 1.0)}


def test_pieces_of_a_long_text_count_like_the_whole(monkeypatch):
    text = "Überall rauscht der Wind, und 12 Häuser stehen. " * 300
    whole = language.counts(text)
    monkeypatch.setattr(language, "PIECE", 1000)
    assert np.abs(language.counts(text) - whole).sum() < 0.02 * whole.sum()


def test_sparse_weights_and_temperature():
    rng = np.random.default_rng(3)
    rows = [(k % 2, np.array([k % 2, 2 + int(rng.integers(400))]), np.array([0.7, 0.7])) for k in range(400)]
    w = language.fit_weights(rows, 2)
    assert w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 > w[1, 0] and (w != 0).any(axis=1).sum() < 300
    logits, y = rng.normal(size=(4000, 3)), []
    for s in logits:  # labels drawn at temperature 1 of logits shown four times as steep
        y.append(rng.choice(3, p=np.exp(s) / np.exp(s).sum()))
    assert abs(language.fit_temperature(4 * logits, np.array(y)) - 4) < 0.5


# 13 --------------------------------------------------------------------------------------------------------------------


def brute_clusters(rows, k=40, rounds=5):
    kept = [(i, np.array([math.floor(256 * x) for x in v], dtype=np.int64)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1].tolist()))[:k]
    c, x = np.array([v for _, v in first]), np.array([v for _, v in kept])
    for turn in range(rounds + 1):
        d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        a = d.argmin(axis=1)
        if turn < rounds:
            c = np.array([x[a == j].sum(axis=0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    best = d[np.arange(len(x)), a]
    inertia = {j: int(best[a == j].sum()) for j in set(a.tolist())}
    sha = [hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest() for v in c]
    return sorted(((i, int(j), int(e), inertia[j], int(best.sum()), sha[j]) for (i, _), j, e in zip(kept, a.tolist(), best)), key=repr)


def test_clusters_equal_brute_force_with_bad_rows_and_copies(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 64))
    rows = [(i, [float(np.float32(v)) for v in centre[i % 6] + 0.2 * rng.normal(size=64)]) for i in range(300)]
    rows += [(i, rows[4][1]) for i in range(300, 420)] + [(7, rows[9][1]), (None, rows[11][1])]
    rows += [(500, None), (501, [1.0] * 63), (502, [float("nan")] * 64), (503, [None] * 64), (504, [float("-inf")] + [0.0] * 63), (505, [])]
    frame = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance string").repartition(4)
    got = centroids.cluster(frame)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_clusters(rows)
    few = centroids.cluster(frame.filter("vec_id < 3"))
    assert [(r.distance, r.inertia) for r in few.collect()] == [(0, 0)] * 3
    assert centroids.cluster(frame.limit(0)).collect() == [] and centroids.cluster(frame.filter("vec_id = 500")).collect() == []


def test_filter_keeps_the_nearest_and_skips_most(spark):
    rng = np.random.default_rng(8)
    x = np.floor(256 * (rng.normal(size=(20, 64))[rng.integers(20, size=2000)] + 0.1 * rng.normal(size=(2000, 64)))).astype(np.int64)
    spread, mean = np.cov(x.T, bias=True), np.round(x.mean(axis=0))
    axes = centroids.Axes(mean, np.linalg.eigh(spread)[1][:, ::-1][:, : centroids.LEADING])
    c = x[:40]
    cluster, distance, verified = centroids.nearest(x, c, axes)
    d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    assert verified < 0.25 * d.size


def test_huge_components_are_held_within_the_bound(spark):
    frame = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in centroids.cluster(frame, k=1, rounds=0).collect()}
    assert len(got) == 3 and max(r.distance for r in got.values()) <= 64 * (2 * centroids.BOUND) ** 2
