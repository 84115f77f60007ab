"""Operators with one right answer, held against brute force: 1, 2, 3, 4, 8 (fixed forms), 9, 10 (base forms)."""

import hashlib
import re
from collections import Counter

import pytest
import xxhash

from zephra.llm import chat, decontamination, fingerprints, html_text, pii, secret_scan, simhash
from zephra.scale import cut_lineage, merged_if_large

SF = "/root/testdata/sf0.001"
WORDS = "ash birch cedar dogwood elm fir ginkgo hazel ivy juniper kauri larch maple nutmeg oak pine quince rowan spruce teak".split()
LONG = " ".join(WORDS[(i * i + i // 7) % 20] for i in range(30_000))
TEXTS = [None, "", "  ", "one", " ".join(WORDS), " ".join(WORDS), " ".join(WORDS).upper() + "!", " ".join(WORDS[:12]) + " zebra", LONG, LONG + " end"]


def documents(spark, texts=TEXTS, ids=None):
    """Texts with ids from 0 and extra columns whose names clash with inner ones."""
    rows = [(i if ids is None else ids[i], t, "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, pos int, label string")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


# 1 ---------------------------------------------------------------------------------------------------------------------


def test_html_keeps_the_article_alone(spark):
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a> <a href=/b>News</a></nav>
    <header>Site</header><div class="cookie-notice">We use cookies</div><main><article><h1>Rain &amp; wind</h1>
    <p>First paragraph of   the report, long enough to be text.<p>Second &#233;t&eacute; paragraph<br>with a break and <b>bold</b> words.</p>
    <script>var x = "<p>no</p>";</script></article><section class="comments"><p>I disagree with all of it, said a reader at length.</p></section></main>
    <aside>Related</aside><form>Mail <input></form><footer>Imprint</footer></body></html>"""
    rows = spark.createDataFrame([(1, page, "clash"), (2, None, ""), (3, "", ""), (4, "<p>open", ""), (1, page, "again")], "page_id long, html string, tags string")
    got = sorted((r.page_id, r.text) for r in html_text.extract(rows).collect())
    text = "Rain & wind First paragraph of the report, long enough to be text. Second été paragraph with a break and bold words."
    assert got == [(1, text), (1, text), (2, ""), (3, ""), (4, "open")]


def test_html_smoothing_and_very_long_pages(spark):
    assert html_text.smoothed([3.0] * 7) == pytest.approx([3.0] * 7)
    body = "".join(f"<p>{LONG[:400]} {i}</p>" for i in range(500))
    assert html_text.main_text(f"<body><nav>a</nav><article>{body}</article></body>").count("ash") >= 500
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []


STORY = "".join(f"<div>{'The river rose again in the night and the road was closed. ' * 4}{i}</div>" for i in range(6))
TOLD = " ".join("The river rose again in the night and the road was closed. " * 4 + str(i) for i in range(6))


def test_html_without_any_names():
    links = "<div><a href=/>Home</a> <a href=/a>News</a> <a href=/b>Sport</a></div>"
    page = f"<body>{links}<div><div>Heading here</div>{STORY}</div><div>Ann wrote: I do not agree with this at all, sorry.</div><div>Imprint</div></body>"
    assert html_text.main_text(page) == "Heading here " + TOLD


def test_html_ratio_finds_the_article_of_pages_stripped_of_names(monkeypatch):
    """Elements and class names of the table's pages made plain: what the names tell must come from the ratio."""
    import pandas as pd

    pages = pd.read_parquet("/root/testdata/sf0.1/pages.parquet").html.tolist()
    bare = [re.sub(r' (class|id|role)="[^"]*"', "", re.sub(r"<(/?)(nav|article|footer|aside|header|main|section|form)\b[^>]*>", r"<\1div>", h)) for h in pages]
    want = [html_text.main_text(h) for h in pages]
    got = [html_text.main_text(h) for h in bare]
    right = sum(a == b for a, b in zip(got, want))
    assert right >= 0.94 * len(pages)
    monkeypatch.setattr(html_text, "content_lines", lambda lines: ([True] * len(lines), 0.0))
    every = [html_text.main_text(h) for h in bare]
    assert sum(a == b for a, b in zip(every, want)) < right and sum(a != b for a, b in zip(every, got)) >= 100


@pytest.mark.parametrize("name", ["article-header", "post-header", "entry-header", "header"])
def test_html_headings_of_an_article_stay(name):
    assert html_text.main_text(f"<body><article><div class='{name}'><h1>Title of it</h1></div>{STORY}</article></body>") == "Title of it " + TOLD


def test_html_side_matter_goes_even_where_it_is_long():
    comments = "<section class='comments'><p>" + "I think so too and more of that. " * 40 + "</p></section>"
    advert = "<div class='ad'>" + "Buy this now and save. " * 30 + "</div>"
    banner = "<div class='banner'>Sale today</div>"
    assert html_text.main_text(f"<body>{banner}{advert}<article>{STORY}{comments}</article><footer>{STORY}</footer></body>") == TOLD
    assert html_text.main_text(f"<body><div hidden>{STORY}</div><div>{STORY}</div></body>") == TOLD


def test_html_with_very_many_open_elements():
    import time

    began = time.time()
    assert html_text.main_text("<div>x " * 50_000).count("x") == 50_000
    assert html_text.main_text("<p>" + "<b>x " * 50_000 + "</i></u><p>y" * 2000).count("y") == 2000
    assert html_text.main_text("<table><tr><td>" * 10_000 + "z").endswith("z")
    assert time.time() - began < 30


# 2 ---------------------------------------------------------------------------------------------------------------------


def jaccard(a, b):
    x, y = Counter((a or "").split()), Counter((b or "").split())
    low, high = sum((x & y).values()), sum((x | y).values())
    return low / high if high else 1.0


@pytest.mark.parametrize("partitions", [1, 5])
def test_fingerprints_of_documents_and_edited_texts(spark, partitions):
    mixed = [" ".join(WORDS[(i + k) % 20] for k in range(i % 9 + 3)) for i in range(60)]
    texts = TEXTS + mixed
    got = {r.doc_id: r for r in fingerprints.fingerprint_with_next(documents(spark, texts).repartition(partitions)).collect()}
    assert len(got) == len(texts)
    errors = []
    for i, t in enumerate(texts):
        text, after = t or "", texts[i - 1] or ""  # the next in descending order; the last wraps to the first
        whole = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(whole))
        errors += [abs(r.near_edited - jaccard(text, whole)), abs(r.near_next - jaccard(text, after))]
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.04
    assert got[4].fingerprint == got[5].fingerprint and got[0].fingerprint == got[1].fingerprint != got[4].fingerprint


def test_fingerprints_of_nothing_null_ids_and_repeated_rows(spark):
    assert fingerprints.fingerprint_with_next(documents(spark, [])).collect() == []
    one = fingerprints.fingerprint_with_next(documents(spark, ["a b c"])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    same = fingerprints.fingerprint_with_next(documents(spark, ["a b", "a b", "c d"], [7, 7, None])).collect()
    assert sorted((r.doc_id or -1) for r in same) == [-1, 7, 7]


# 3 ---------------------------------------------------------------------------------------------------------------------


def contaminated(texts, items, window=10):
    out = {}
    for i, t in enumerate(texts):
        w, hit, named = words(t), set(), set()
        for name, text in items:
            v = words(text)
            k = min(window, len(v))
            for s in range(len(v) - k + 1 if k else 0):
                for at in range(len(w) - k + 1):
                    if w[at : at + k] == v[s : s + k]:
                        hit |= set(range(at, at + k))
                        named.add("NULL" if name is None else name)
        out[i] = (len(w), len(hit), len(named), sha(",".join(sorted(named))), bool(hit))
    return out


def test_decontamination_is_exact(spark):
    texts = [t for t in TEXTS if t is None or len(t) < 1000] + [
        "a a a a a a a a a a a a a a", " ".join(WORDS[3:13]) + " " + " ".join(WORDS[3:12]), "x one, y ONE", " ".join(reversed(WORDS)), "café oneé"
    ]
    items = [
        ("b1", " ".join(WORDS[2:15])), ("b1", "quite another text of the same id"), ("b2", "one"), ("b3", "a a a a a a a a a a a"), (None, " ".join(WORDS[:11])),
        ("b4", None), ("b5", "..."), ("b6", "Café ONEé"), ("b7", " ".join(WORDS[8:12]) + " absent " + " ".join(WORDS[12:20])),
    ]
    bench = spark.createDataFrame([(a, b, "z") for a, b in items], "item_id string, text string, term string")
    docs = documents(spark, texts)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.contamination(docs, bench).collect()}
    want = contaminated(texts, items)
    assert got == want
    kept = decontamination.without_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, v in want.items() if not v[4]}


def test_decontamination_in_proximity_and_of_nothing(spark):
    docs, bench = documents(spark, ["p ash q birch cedar", "cedar far ash"]), spark.createDataFrame([("i", "ash birch cedar")], "item_id string, text string")
    near = {r.doc_id: r.contaminated for r in decontamination.contamination(docs, bench, slack=1).collect()}
    assert near == {0: True, 1: False}
    assert not any(r.contaminated for r in decontamination.contamination(docs, bench.filter("false")).collect())
    assert decontamination.contamination(docs.filter("false"), bench).collect() == []
    twice = decontamination.contamination(documents(spark, ["ash birch cedar", "ash birch cedar", "no"], [5, 5, 5]), bench).collect()
    assert sorted(r.n_hit for r in twice) == [0, 3, 3]


# 4 ---------------------------------------------------------------------------------------------------------------------


def print_of(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def linked(prints, tau):
    """Smallest index reachable, by comparing all pairs."""
    least = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= tau and least[j] < least[i]:
                    least[i], changed = least[j], True
    return least


def test_simhash_groups_are_those_of_all_pairs(spark):
    base = LONG[:3000].split()
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in range(40, 240, 20)]
    texts = [t for t in TEXTS if t is None or len(t) < 1000] + near + near[:3]
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints = [print_of(t) for t in texts]
    assert [got[i][0] for i in range(len(texts))] == prints
    assert [got[i][1] for i in range(len(texts))] == linked(prints, 4)
    kept = simhash.one_of_each(documents(spark, texts))
    assert {r.doc_id for r in kept.collect()} == set(linked(prints, 4)) and kept.columns == documents(spark).columns


@pytest.mark.parametrize("bucket", [2, 2048])
def test_simhash_links_lose_no_pair_in_crowded_buckets(spark, bucket):
    mask = (1 << 64) - 1
    x, prints = 12345, set()
    for i in range(120):
        x = (x * 6364136223846793005 + 1442695040888963407) & mask
        prints |= {x, x ^ (1 << i % 64), x ^ (7 << i % 60), x ^ (0b101011 << i % 58)}
    centre = 0x0F0F3C3C5A5A9999
    prints |= {centre ^ (1 << i) ^ (1 << j) for i in range(0, 64, 5) for j in range(0, 64, 7)}
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    pairs = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) & mask).bit_count() <= 4}
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    assert {(r.u, r.v) for r in simhash.links(nodes, 4, bucket).collect()} == pairs


def test_simhash_probes_are_not_broadcast(spark):
    """Spark sizes the exploded probes as the fingerprints they come from; they are joined by a merge at any size."""
    nodes = cut_lineage(spark.createDataFrame([(i * 0x9E3779B97F4A7C15 % 2**63,) for i in range(300)], "fp long"))
    for bucket in (simhash.BUCKET, 2):
        plan = simhash.links(nodes, 4, bucket)._jdf.queryExecution().executedPlan().toString()
        top = plan[plan.index("Join"):].splitlines()[0]
        assert "bit_count" in top and plan[: plan.index("Join")].endswith("SortMerge")


def test_simhash_broadcasts_go_by_rows(spark, monkeypatch):
    """Tables of more rows than the bound are merged, whatever Spark takes them for, with equal results."""
    texts = [f"{a} {b} {a}{b} and the rest of it" for a in WORDS for b in WORDS[:4]] * 2
    docs = documents(spark, texts)
    want = sorted(map(tuple, simhash.near_duplicates(docs).collect())), sorted(r.doc_id for r in simhash.one_of_each(docs).collect())
    bounds = []

    def low(df, rows=None):
        bounds.append(rows)
        return merged_if_large(df, 10)

    monkeypatch.setattr(simhash, "merged_if_large", low)
    for made in (simhash.near_duplicates(docs), simhash.one_of_each(docs)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=merge" in plan.replace(" ", "")
        rows = sorted(map(tuple, made.collect()))
        assert rows == want[0] if len(rows[0]) == 3 else [r[0] for r in rows] == want[1]
    assert len(bounds) == 5


def test_simhash_thresholds_and_empty_table(spark):
    cost, ts = simhash.allocate([[0, 5, 50, 500, 5000, 50000], [0, 1, 2, 3, 400, 50000]], 4)
    assert sum(t + 1 for t in ts) == 5 and (cost, ts) == (53, [1, 2])
    assert simhash.near_duplicates(documents(spark, [])).collect() == []
    odd = simhash.one_of_each(documents(spark, ["a b c d e", "a b c d e", None, "other words are here now"], [None, None, 3, 3])).collect()
    assert sorted((r.doc_id is None, r.text or "") for r in odd) == [(False, ""), (False, "other words are here now"), (True, "a b c d e")]


# 8 and 10 --------------------------------------------------------------------------------------------------------------

PERSONAL = [
    None, "", "no data", "mail a.b+c@x-y.example.org, 10.0.0.1 and 300.1.1.1 or 1.2.3.4.5", "card 4111 1111 1111 1111 or 4111 1111 1111 1112",
    "call +49 (30) 1234-567 or +1 2", "é\U0001f600 x@y.de \U0001f600 +44 20 7946 0958.", "x@y 1.1.1 4111-1111", "a@b.c@d.e 4111111111111111 0000000000000000",
]


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 * (x > 4)) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def personal(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    forms = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in forms for m in re.finditer(p, text or "") if ok(m[0])]


def secrets(text):
    forms = [
        ("assign", r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 32),
    ]
    found = [(m.start(), i, (k, m.start(), m.end())) for i, (k, p, f, ok) in enumerate(forms) for m in re.finditer(p, text or "", f) if ok(m)]
    return [s for _, _, s in sorted(found)]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def both(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    return dict(docs)


def test_pii_base_spans_on_whole_documents(spark):
    texts = both(spark)
    got = pii.op10_pii(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = personal(texts[r.doc_id])
        assert r.base_sha256 == sha(listed(want)) and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in pii.KINDS]
        assert set(listed(want).split(",")) - {""} <= set(r.spans.split(","))


def test_pii_odd_texts_and_redaction(spark):
    docs = documents(spark, PERSONAL + [LONG + " x@y.de"])
    got = {r.doc_id: [(pii.KINDS[s.kind], s.start, s.end) for s in r._base] for r in pii.find(docs, pii.Model()).collect()}
    assert got == {i: personal(t) for i, t in enumerate([*PERSONAL, LONG + " x@y.de"])}
    out = pii.redacted(docs, pii.Model())
    clean = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == docs.columns and clean[0] is None and clean[2] == "no data"
    assert clean[6] == "é\U0001f600 [EMAIL] \U0001f600 [PHONE]." and clean[9] == LONG + " [EMAIL]"
    assert pii.find(docs.filter("false"), pii.fit(docs.filter("false"))).collect() == []


def test_secret_base_spans_on_whole_documents(spark):
    texts = both(spark)
    got = secret_scan.op8_secrets(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = secrets(texts[r.doc_id])
        assert r.base_sha256 == sha(listed(want)) and [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex")]
        assert set(listed(want).split(",")) - {""} <= set(r.spans.split(","))


def test_secret_odd_texts(spark):
    texts = [
        None, "", "Token='abcdefgh' toKen=short", "PASSWORD : é password:p4ssw0rdp4ss", "AKIA" + "A" * 11, "AKIA" + "A" * 12, "ſecret=abcdefghij api_key=\"Zz9/+_.=-a\"",
        "f" * 31 + "g" + "0" * 40, LONG + " apikey=0123456789",
    ]
    got = {r.doc_id: r.spans for r in secret_scan.scan(documents(spark, texts), None).collect()}
    assert got == {i: listed(secrets(t)) for i, t in enumerate(texts)}
    assert secret_scan.scan(documents(spark, []), secret_scan.fit(documents(spark, []))).collect() == []


# 9 ---------------------------------------------------------------------------------------------------------------------


def test_chat_round_trip_of_conflicting_texts(spark):
    odd = [
        None, "", "</turn>", "</turn>\n### User: hi", "<\\/turn> <\\\\/turn>", "### Assistant: x", "###\\ System: y", "### Role=a%20b: z", "\\", "\n", "### User:",
        "</turn", "a</turn>\n</turn>\n", "$1 \\1", "###### User: ### User: ", LONG,
    ]
    roles = ["system", "user", "assistant", None, "", "tool x", "### User: </turn>\n", "User"]
    rows = [(c, k, roles[(c + k) % 8], odd[(3 * c + k) % 16], "x") for c in range(16) for k in range(6)] + [(None, 0, "user", "no id", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = chat.format_conversations(turns).collect()
    assert len(got) == 17 and all(r.identical for r in got)
    for r in got:
        want = [(role or "", text or "") for c, _, role, text, _ in rows if c == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == want
    assert chat.format_conversations(turns.filter("false")).collect() == []
