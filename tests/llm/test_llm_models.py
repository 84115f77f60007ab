"""Operators with a fitted model or drawn rows, held against held-out rows and exact margins: 5, 6, 7, 8, 10; and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from zephra.llm import catalog, decontamination, mixing, pii, quality, secret_scan, simhash, toxicity

SF = "/root/testdata/sf0.001"
FILL = "the of and rain wind river stone road light field paper house water cloud green early".split()


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    _, inverse, n = np.unique(score[order], return_inverse=True, return_counts=True)
    rank[order] = (np.cumsum(n) - (n - 1) / 2)[inverse]
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def filler(i, n):
    return [FILL[(i * 7 + k * k + k // 3) % len(FILL)] for k in range(n)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def toxic_docs(spark):
    rows = []
    for i in range(400):
        w = filler(i, 60 + i % 40)
        if i % 4 == 0:
            w[20:24] = [["vile", "scum", "rotten", "filth"][(i // 4 + k) % 4] for k in range(4)]
        rows.append((i, " ".join(w), int(i % 4 == 0), "clash"))
    return frame(spark, rows, "doc_id long, text string, toxic int, score string").cache()


def test_toxicity_finds_passages_in_held_out_documents(spark, toxic_docs):
    docs, labels = toxic_docs.select("doc_id", "text"), toxic_docs.select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    rows = toxicity.with_score(toxic_docs.drop("score"), model).filter(toxicity.held_out()).collect()
    assert all((r.score >= toxicity.CUT) == (r.toxic == 1) for r in rows)
    buried = " ".join(filler(1, 20_000)) + " vile scum rotten filth vile scum " + " ".join(filler(2, 20_000))
    odd = frame(spark, [(1, None), (2, ""), (3, buried), (None, "vile scum rotten filth")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.with_score(odd, model).collect()}
    assert all(0 <= s <= 1 for s in score.values()) and score[1] == score[2] < 0.5 and min(score[3], score[None]) > toxicity.CUT


def test_toxicity_without_labels_and_on_the_tables(spark, toxic_docs):
    none = toxicity.fit(toxic_docs.select("doc_id", "text"), frame(spark, [(1, None), (99999, 1)], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.with_score(toxic_docs.drop("score"), none).collect()} == {0.0}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    out = [r for r in toxicity.op5_toxicity(spark, "/root/testdata/sf0.01").collect() if r.held_out and labels.get(r.doc_id) is not None]
    assert auc(np.array([r.score for r in out]), np.array([labels[r.doc_id] for r in out])) > 0.85


def test_maximal_segments_are_those_of_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        s = np.round(rng.normal(-0.3, 1.2, 14), 2)

        def divide(lo, hi):
            best = max(((s[a:b].sum(), a - b, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
            if best is None or best[0] <= 1e-9:
                return []
            top = [c for c in ((s[a:b].sum(), b - a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)) if abs(c[0] - best[0]) < 1e-9]
            _, _, a, b = min(top, key=lambda c: c[1])
            return divide(lo, a) + [(a, b)] + divide(b, hi)

        got = [(a, b) for a, b, _ in toxicity.maximal_segments([(i, float(x)) for i, x in enumerate(s)], -0.1)]
        assert got == divide(0, len(s))


def test_quality_orders_documents_by_grade(spark):
    def text(i, grade):
        w = filler(i, 80)
        for k in range(0, 80, 2 + 3 * grade):
            w[k] = "##" if k % 2 else "404"
        return " ".join(w)

    rows = [(i, text(i, i % 4), i % 4, "x") for i in range(400)]
    docs = frame(spark, rows, "doc_id long, text string, quality int, expected_grade string")
    model = quality.fit(docs, docs.filter("doc_id < 300").select("doc_id", "quality"))
    assert list(model[0]) == [0, 1, 2, 3] and all(np.diff(model[1]) > 0)
    out = quality.with_grade(docs.drop("expected_grade").filter("doc_id >= 300"), model).collect()
    by = [np.mean([r.expected_grade for r in out if r.quality == g]) for g in range(4)]
    assert by == sorted(by) and by[3] - by[0] > 2
    kept = quality.select_documents(docs, model)
    assert kept.columns == docs.columns and {r.quality for r in kept.collect()} == {3}


def test_quality_without_ratings_and_odd_texts(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "word " * 50_000), (3, "a b")], "doc_id long, text string")
    none = quality.fit(docs, frame(spark, [(1, None), (9, 2)], "doc_id long, quality int"))
    assert none is None and quality.select_documents(docs, none).count() == 4
    single = quality.fit(docs, frame(spark, [(3, 2)], "doc_id long, quality int"))
    assert {r.expected_grade for r in quality.with_grade(docs, single).collect()} == {2.0}
    assert quality.with_grade(docs.filter("false"), single).collect() == []


def test_mixing_reaches_the_margins(spark):
    rows = [(i, " ".join(filler(i, 20 + i % 9)), "hot" if i % 3 else f"s{i % 5}", None if i % 7 == 0 else ["en", "de"][i % 2], i % 4) for i in range(3000)]
    docs = frame(spark, [*rows, (None, "", "hot", "en", 1), (3001, None, "only empty", "en", 1)], "doc_id long, text string, source string, lang string, topic int")
    cells = docs.select(*[mixing._category(c).alias(m) for c, m in zip(("source", "lang", "topic"), mixing.MARGINS)], F.size(F.split("text", " ")).alias("_t"))
    cells = cells.filter("_t > 1").groupBy(*mixing.MARGINS).agg(F.sum("_t").alias("_t"))
    targets = mixing.flattened_targets(cells)
    fitted = mixing.raked(cells, targets, rounds=25).toPandas()
    mass = fitted["_w"] * fitted["_t"] / fitted["_t"].sum()
    for m in mixing.MARGINS:
        want = {r[0]: r[1] for r in targets[m].collect()}
        assert mass.groupby(fitted[m]).sum().to_dict() == pytest.approx(want, rel=1e-3)
    drawn = mixing.sample(docs)
    got = drawn.toPandas()
    assert drawn.columns == [*docs.columns, "n_tokens", "probability", "weight"] and (got["n_tokens"] > 0).all()
    assert sorted(got["doc_id"]) == sorted(r.doc_id for r in mixing.sample(docs.repartition(7)).collect())
    share = (got["n_tokens"] * got["weight"]).groupby(got["source"]).sum() / (got["n_tokens"] * got["weight"]).sum()
    assert share["hot"] == pytest.approx({r[0]: r[1] for r in targets["_source"].collect()}["hot"], abs=0.05)
    assert mixing.sample(docs.filter("false")).collect() == []


def test_secret_field_adds_spans_like_those_of_the_forms(spark):
    def key(i, n):
        return "".join("aB3dE5gH7jK9mN2pQ4sT6vW8xY0zC1f"[(i * 13 + k * k * 5 + k) % 31] for k in range(n))

    known = [(i, " ".join(filler(i, 30)) + f" token={key(i, 24)} " + " ".join(filler(i + 1, 9)) + f" version {i} of 2024") for i in range(300)]
    docs = frame(spark, known, "doc_id long, text string")
    model = secret_scan.fit(docs)
    new = frame(spark, [(1, f"the river key={key(77, 24)} and rain"), (2, "in 2024 the road 66 of 12 stones"), (3, None)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secret_scan.scan(new, model).collect()}
    assert spans[2] == spans[3] == "" and spans[1].startswith("field:")


def test_viterbi_is_the_best_of_all_tag_sequences():
    rng = np.random.default_rng(3)
    import itertools

    for _ in range(30):
        e, move = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
        tags = secret_scan.viterbi(e, move)
        value = lambda ts: sum(e[i, t] for i, t in enumerate(ts)) + sum(move[a, b] for a, b in zip((secret_scan.OUT, *ts), (*ts, secret_scan.OUT)))
        legal = [ts for ts in itertools.product(range(3), repeat=5)]
        assert value(tuple(tags)) == pytest.approx(max(map(value, legal)))
        # Forward and backward sums against the sum over all sequences.
        a, b, z = (v[0] for v in secret_scan.sums(e[None], move))
        weights = {ts: np.exp(value(ts)) for ts in legal}
        assert np.exp(z) == pytest.approx(sum(weights.values()))
        p = np.exp(a + b - z)
        assert p[2, 1] == pytest.approx(sum(w for ts, w in weights.items() if ts[2] == 1) / sum(weights.values()))


@pytest.fixture(scope="module")
def secret_field(spark):
    """Fitted on the documents of even number."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 2 = 0")
    return secret_scan.fit(docs.select("doc_id", "text"), 600)


def test_secrets_with_their_announcement_hidden(spark, secret_field):
    """Tried on the secrets of the other half, written in another way and mostly unannounced."""
    import random

    model = secret_field
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 2 = 1 and text rlike '[0-9]'")
    rest = [r.text for r in docs.select("text").collect()]
    found = outside = hidden = caught = 0
    rnd = random.Random(1)
    for text in rest:
        inside = secret_scan.values(text)
        spans = secret_scan.field_spans(text, *model)
        found += len(spans)
        outside += sum(not any(a <= x and y <= b for a, b in inside) for x, y in spans)
        if inside:
            other, secrets = secret_scan.altered(text, rnd)
            hidden += len(secrets)
            caught += len(set(secrets) & set(secret_scan.field_spans(other, *model)))
    assert found >= 50 and outside <= 0.05 * found
    assert hidden >= 50 and caught >= 0.9 * hidden


def test_field_in_plain_words_and_long_lines(secret_field):
    model = secret_field
    texts = {
        "the passphrase = wQrTyUp9LkJhGfDsAzXc4 and then": ["wQrTyUp9LkJhGfDsAzXc4"],
        "call at 2024-05-17T10:22:33 or 192.168.1.100 or +44 20 7946 0958": [],
        "card 4111-1111-1111-1111, see page 12345678 of the internationalization": [],
        "word " * 20_000 + "key wQrTyUp9LkJhGfDsAzXc4Z7 " + "a" * 100_000: ["wQrTyUp9LkJhGfDsAzXc4Z7"],
    }
    for text, want in texts.items():
        assert [text[a:b] for a, b in secret_scan.field_spans(text, *model)] == want


def test_field_looks_at_every_token_of_every_line():
    """A secret without a digit and of fewer than 20 signs, far from any number; lines of many lengths at once."""
    rng = np.random.default_rng(5)
    w, t = rng.normal(size=(secret_scan.DIMS, 3)), rng.normal(size=(3, 3))
    words = ["river", "stone:", "=", "xK9dQ2mZ7pL4wT8v", "hQrTyUpLkJhGfDs", "'", "a-b/c", "7", "\u00e9t\u00e9", "#", "token"]
    texts = ["\n".join(" ".join(rng.choice(words, size=rng.integers(0, 90))) for _ in range(rng.integers(1, 9))) for _ in range(40)]
    texts += ["", "\n\n", "x", "word " * 3000 + "hQrTyUpLkJhGfDs"]
    got = secret_scan.spans_of(texts, w, t)
    for text, spans in zip(texts, got, strict=True):
        want, at = [], 0
        for line in text.split("\n"):
            places, x = secret_scan.chain(text, at, at + len(line), secret_scan._file(text))
            at += len(line) + 1
            if not places:
                continue
            e, move = w[x].sum(axis=1), t + secret_scan._ALLOWED
            tags = secret_scan.viterbi(e, move)
            want += secret_scan.likely_spans(e, move, tags, places)
        assert spans == want
    assert sum(map(len, got)) > 50
    plain = "stones by the river and hQrTyUpLkJhGfDs there"
    spans, x = secret_scan.chain(plain, 0, len(plain), "00")
    y = [secret_scan.BEGIN if plain[a:b].startswith("hQr") else secret_scan.OUT for a, b in spans]
    w, t = secret_scan.fit_field([(x, y)] * 4, 60)
    assert [plain[a:b] for a, b in secret_scan.field_spans(plain, w, t)] == ["hQrTyUpLkJhGfDs"]


def test_field_on_odd_tokens_and_lines_proven_outside():
    """All spans of the one-line code, whatever the characters and however few lines a bound leaves to Viterbi."""
    rng = np.random.default_rng(8)
    parts = [
        "password", "AKIA1234", "ghp_ab", "gh", "sk-", "eyJhb", "apiKEY", "Key", "\n", "\n", " ", " ", "=", ": ", "'", "Q9x", "\u00e9", "-", "--", "12", "\u00bd", "\u00b2",
        "\u6f22", "\U0001f600", "\u017f", "\u212a", "\u3000", "\x85", "\x1c", "\x00", "\r", "wQrTyUp9LkJhGfDsAzXc4",
    ]
    texts = ["".join(rng.choice(parts, size=rng.integers(0, 70))) for _ in range(300)] + ["", "\n"]
    w, t = rng.normal(size=(secret_scan.DIMS, 3)), rng.normal(size=(3, 3))
    for outside in (0.0, 0.1, 0.1):
        w[:, secret_scan.OUT] += outside
        found = 0
        for text, spans in zip(texts, secret_scan.spans_of(texts, w, t), strict=True):
            want, at = [], 0
            for line in text.split("\n"):
                places, x = secret_scan.chain(text, at, at + len(line), secret_scan._file(text))
                at += len(line) + 1
                if places:
                    e, move = w[x].sum(axis=1), t + secret_scan._ALLOWED
                    want += secret_scan.likely_spans(e, move, secret_scan.viterbi(e, move), places)
            assert spans == want
            found += len(spans)
        assert found


def test_scan_takes_few_steps_a_token():
    """No call of Python for each token: what a token looks like is taken from arrays of all characters of a group."""
    import sys

    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), size=rng.integers(2, 12))) for _ in range(20_000)]
    text = "\n".join(" ".join(words[i : i + 50]) for i in range(0, 20_000, 50))
    w, t = rng.normal(size=(secret_scan.DIMS, 3)) + np.array([2.0, 0.0, 0.0]), np.zeros((3, 3))
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        secret_scan.spans_of([text], w, t)
    finally:
        sys.setprofile(None)
    assert calls < len(words) // 2


def test_fit_sums_the_weights_of_equal_tokens_once(monkeypatch):
    """Chains of uneven lengths, against the sums of each chain by itself."""
    rng = np.random.default_rng(10)
    looks = rng.integers(0, secret_scan.DIMS, size=(12, secret_scan.N_FEATURES))
    data = []
    for n in [1, 1, 2, 5, 30, 64, 64, *rng.integers(1, 40, size=40)]:
        y = rng.choice([-1, 0, 0, 0, 1], size=n)
        y[1:][(y[:-1] == 1) & (y[1:] == 0)] = secret_scan.INSIDE
        data.append((looks[rng.integers(0, 12, size=n)], y.tolist()))
    w, t = np.zeros((secret_scan.DIMS, 3)), np.zeros((3, 3))
    moments = np.zeros((2, secret_scan.DIMS + 3, 3))
    for step in range(1, 6):
        move, gw, gt = t + secret_scan._ALLOWED, -secret_scan.RIDGE * w, -secret_scan.RIDGE * t
        for x, y in data:
            known = np.where((np.array(y)[:, None] < 0) | (np.array(y)[:, None] == np.arange(3)), 0.0, -1e4)
            for sign, e in ((1, w[x].sum(axis=1) + known), (-1, w[x].sum(axis=1))):
                a, b, z = (v[0] for v in secret_scan.sums(e[None], move))
                p = np.exp(a + b - z)
                np.add.at(gw, x, sign * p[:, None, :] / len(data))
                moves = np.exp(a[:-1, :, None] + move + (e + b)[1:, None, :] - z).sum(axis=0)
                moves[secret_scan.OUT] += p[0]
                moves[:, secret_scan.OUT] += p[-1]
                gt += sign * moves / len(data)
        g = np.concatenate([gw, gt])
        moments = np.stack([0.9 * moments[0] + 0.1 * g, 0.999 * moments[1] + 0.001 * g * g])
        by = secret_scan.RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        w, t = w + by[:-3], t + by[-3:]
    counted, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, **k: (counted.append(len(x)), bincount(x, **k))[1])
    got = secret_scan.fit_field(data, 5)
    assert got[0] == pytest.approx(w, abs=1e-6) and got[1] == pytest.approx(t, abs=1e-6)
    assert max(counted) <= sum(len(y) for _, y in data)


def test_tokens_of_unknown_tag_are_not_taught_as_outside():
    text = "plain words and xK9dQ2mZ7pL4wT8v here"
    spans, x = secret_scan.chain(text, 0, len(text), "")
    assert secret_scan._tags(text, spans, []) == [0, 0, 0, -1, 0]
    assert secret_scan._tags(text, spans, [(16, 32)]) == [0, 0, 0, 1, 0]
    w, t = secret_scan.fit_field([(x, [0, 0, 0, -1, 0])] * 4 + [(x, [0, 0, 0, 1, 0])], 30)
    assert [text[a:b] for a, b in secret_scan.field_spans(text, w, t)] == ["xK9dQ2mZ7pL4wT8v"]


def test_personal_data_is_added_by_context(spark):
    """Candidates that no base form takes: announced ones are added, numbers announced as something else are not."""
    model = pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))

    def splits(node):
        if node.getClass().getSimpleName() == "LeafNode":
            return []
        return [node.split().featureIndex(), *splits(node.leftChild()), *splits(node.rightChild())]

    assert pii.CONTEXT_FEATURES & {f for root in model.trees for f in splits(root)} and len(set(model.thresholds.values())) >= 3
    good, bad = [], []
    for i in range(60):
        number = f"{200 + i}-555-{1000 + 37 * i}"
        good += [f"please {['call', 'phone:', 'fax', 'mobile'][i % 4]} {number} today", f"{['mail', 'contact'][i % 2]} ann.lee{i} [at] mail{i}.example [dot] com now"]
        bad += [f"the {['order', 'invoice', 'serial', 'ticket'][i % 4]} {number} is late", f"part no. {number} of {i}"]
    rows = [(i, t, "clash", "kept", 3) for i, t in enumerate(good + bad)]
    got = pii.find(frame(spark, rows, "doc_id long, text string, _base string, _c0 string, _row int"), model)
    assert got.columns == ["doc_id", "text", "_c0", "_row", "_base", "_added"]
    got = got.collect()
    assert {(r._c0, r._row) for r in got} == {("kept", 3)}
    added = {r.doc_id for r in got if r._added}
    caught = len([i for i in added if i < len(good)])
    assert caught >= 0.9 * len(good) and caught >= 0.9 * len(added)
    assert not any(r._base for r in got)


def test_personal_data_is_learnt_from_all_documents(spark):
    """8,200 texts with one address each, some repeated: each text counts once, none is left out."""
    mails = [f"write to user{i}@mail.example.com" for i in range(8200)]
    docs = frame(spark, list(enumerate([*mails, *mails[:50], None, "no sign"])), "doc_id long, text string")
    rows = pii.example_rows(docs)
    per = {(r.part, r.label): r.n for r in rows.groupBy("part", "label").agg(F.sum("weight").alias("n")).collect()}
    # Four forms of either outcome of a span that passes; the numbers 10 to 8199 are card candidates that fail.
    assert {y: per[0, y] + per[1, y] for y in (1.0, 0.0)} == {1.0: 4 * 8200, 0.0: 4 * 8200 + 8190}
    assert abs(per[0, 1.0] - per[1, 1.0]) < 0.1 * 4 * 8200
    assert rows.count() < 500


def test_personal_data_in_a_text_of_many_matches(spark):
    import time

    n = 100_000
    text = " ".join(f"user{i}@mail.example.com" for i in range(n))
    docs = frame(spark, [(1, text), (2, text[:-4]), (3, None)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in pii.find(docs, pii.Model()).select("doc_id", F.size("_base").alias("n"), F.element_at("_base", -1).alias("last")).filter("n > 0").collect()}
    assert got[1].n == got[2].n == n and got[1].last.end == len(text) and text[got[1].last.start :] == f"user{n - 1}@mail.example.com"
    out = {r.doc_id: r.text for r in pii.redacted(docs, pii.Model()).collect()}
    assert out[1] == out[2] == " ".join(["[EMAIL]"] * n) and out[3] is None
    assert time.time() - began < 90


def test_running_folds_and_isotonic_fit(spark):
    for values in ([], [5], list(range(300)), [(7 * i * i) % 101 for i in range(1000)]):
        row = spark.createDataFrame([(values,)], "v array<bigint>").select(pii._sums(F.col("v")).alias("s"), pii._maxima(F.col("v")).alias("m")).first()
        assert row.s == [sum(values[:i]) for i in range(len(values))] and row.m == [max([0, *values[:i]]) for i in range(len(values))]
    assert pii.isotonic([(3, 1, 1), (1, 2, 1), (2, 2, 0), (4, 4, 3)]) == [(1, 0.25), (3, 0.8)]


def test_registered_queries_and_columns(spark):
    found, sqls = catalog.load()
    assert [int(n[2:].split("_")[0]) for n in found] == list(range(1, 14)) and set(sqls) <= set(found)


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "pii_redaction", "source_mixing"]
    before, made = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.cut_lineage(stage(spark, before, SF))
        if name != "source_mixing":
            assert after.columns == docs.columns
        a, b = {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in after.collect()}
        assert set(b) <= set(a)
        made[name] = (before, a, b)
        before = after
    before, a, b = made["quality_classifier"]
    tail = quality.with_grade(before, quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    assert set(b) == {r.doc_id for r in tail if r.tail_probability >= quality.KEEP_TAIL}
    _, a, b = made["simhash_near_dedup"]
    prints = {i: simhash.simhash(t) for i, t in a.items()}
    least = {i: i for i in a}
    changed = True
    while changed:
        changed = False
        for i in a:
            low = min(least[j] for j in a if (prints[i] ^ prints[j]).bit_count() <= 4)
            if low < least[i]:
                least[i], changed = low, True
    assert set(b) == set(least.values())
    before, a, b = made["benchmark_decontamination"]
    bad = decontamination.contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert set(a) - set(b) == {r.doc_id for r in bad.collect() if r.contaminated}
    before, a, b = made["pii_redaction"]
    assert set(a) == set(b)
    left = pii.find(frame(spark, list(b.items()), "doc_id long, text string"), pii.Model())
    assert left.filter(F.size("_base") > 0).count() == 0
    final = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert final == set(made["source_mixing"][2])
