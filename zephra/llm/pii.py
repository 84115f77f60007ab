"""Personal data by candidate generation and gradient boosting; DataFrame operations only.

Generators propose spans of high recall, which may overlap: the four base forms (e-mail, IP address, card, phone) before any
check, and narrower or looser forms of them. Base spans that pass their checks always stay. Of the other candidates those are
added that overlap no base span, are accepted by boosted trees, and pass the check of their kind where it has one.

The trees score a candidate by its format (length, digits, signs, first digits) and its context (the words before it, the signs
on either side, digits near by). They are not shown the checks. All documents take part in the fit, halved by a hash of
their text, copies of a text counted once. On the candidates of one half the trees are fitted: positive are base spans that
pass, as they stand, in a looser form, and after a word that announces them; negative are candidates that fail, and base spans
with other digits in a looser form, most of them after a word that announces another number. On the candidates of the other
half an isotonic fit per kind turns scores into probabilities; the threshold of a kind is the least score of probability
``ACCEPTED``. The trees become plain column expressions, so a document is scored within its row.

Positions are code points, end exclusive. They and the overlaps come from running sums and maxima, taken in blocks of ``BLOCK``
matches, so a text with very many matches takes time in proportion to them.

Defined results: NULL equals an empty text and has no span. Without candidates of both outcomes nothing is fitted and
nothing added. Each row is handled by itself, so ties and repeated rows get equal results; an empty table gives no rows. All
columns of the input stay; ``_base`` and ``_added`` of ``find`` replace input columns of these names, ``redacted`` keeps them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zephra.llm.catalog import query, table
from zephra.scale import cut_lineage

KINDS = ["email", "ip", "card", "phone"]
ACCEPTED = 0.9
TREES, DEPTH = 10, 3
BLOCK = 128
_CONTEXT = 24
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_LOCAL = "[A-Za-z0-9._%+-]"
#: (kind, base form, signs a text must hold, pattern). Possessive loops and the lookbehind match the plain forms of the base
#: kinds (a match begins where a run begins, or where the match before it ended) without trying a long run from every place.
GENERATORS = [
    ("email", True, ["@"], rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", True, ["."], r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", True, [], r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", True, ["+"], r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", False, ["at"], rf"(?<!{_LOCAL}){_LOCAL}++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++"),
    ("card", False, [], r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])"),
    ("phone", False, ["+"], r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"),
    ("phone", False, ["-"], r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20|[0-9]{3}-)[0-9]{3}-[0-9]{4}(?![0-9-])"),
]
_SPAN = "struct<kind:int,start:bigint,end:bigint,passed:boolean,s:string,before:string,after:string>"
# Words that announce personal data, and words that announce other numbers.
CUES = {
    "email": ["e-mail", "mail", "contact", "write to", "reach"], "ip": ["ip", "host", "address", "server", "from"],
    "card": ["card", "visa", "credit", "paid with", "account"], "phone": ["phone", "tel", "call", "mobile", "fax"],
}
OTHER = ["version", "order", "invoice", "isbn", "build", "ticket", "serial", "item", "part", "id", "ref", "page"]
_OTHER = rf"(?i)(?<![a-z])(?:{'|'.join(OTHER)})\W*(?:no|number|nr)?\W*$"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    """Checksum of at most 19 digits; false for more."""
    d = F.reverse(_digits(s))

    def worth(i: Column) -> Column:
        x = F.substr(d, i, F.lit(1)).cast("int")
        twice = x * 2
        return F.when(i % 2 == 1, x).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + worth(i))
    return F.when(F.length(d).between(2, 19), total % 10 == 0).otherwise(False)


def _passes(kind: str, s: Column) -> Column:
    n = F.length(_digits(s))
    if kind == "ip":
        return s.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return n.between(16, 19) & _luhn(s)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _features(kind: str, s: Column, before: Column, after: Column) -> list[Column]:
    first = F.substring(_digits(s), 1, 1)
    cue = "|".join(CUES[kind])
    return [
        F.lit(KINDS.index(kind)),
        F.length(s),
        F.length(_digits(s)),
        F.regexp_count(s, F.lit(r"[^0-9A-Za-z]")),
        F.regexp_count(s, F.lit(r"[ (\[]")),
        F.regexp_count(s, F.lit(r"\.")),
        s.startswith("+"),
        F.coalesce(first.try_cast("int"), F.lit(-1)),
        before.rlike(r"[0-9A-Za-z_#.-]$"),
        after.rlike(r"^[0-9A-Za-z_-]"),
        before.rlike(rf"(?i)(?<![a-z])(?:{cue})\W*$"),
        before.rlike(_OTHER),
        before.rlike("[0-9]"),
        before.rlike(r"(?:^|\n)\W*$"),
    ]


FEATURES = 14
CONTEXT_FEATURES = {8, 9, 10, 11, 12, 13}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once a row; a column used inside a lambda could be made anew for each element."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, zero: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """Array of the fold over all values before each, by blocks: folds of whole blocks first, then within each block."""

    def of(v: Column) -> Column:
        n = F.size(v)
        blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))
        part = lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))
        whole = F.transform(blocks, lambda b: F.aggregate(part(b), zero, fold))

        def inner(w: Column) -> Column:
            def block(b: Column) -> Column:
                held = F.struct(part(b).alias("p"), F.aggregate(F.slice(w, F.lit(1), b), zero, fold).alias("z"))
                return _let(held, lambda h: F.transform(h["p"], lambda _, i: F.aggregate(F.slice(h["p"], F.lit(1), i), h["z"], fold)))

            return F.flatten(F.transform(blocks, block))

        return _let(whole, inner)

    return _let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array().cast("array<bigint>")))


def _sums(values: Column) -> Column:
    return _running(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _maxima(values: Column) -> Column:
    return _running(values, F.lit(0).cast("long"), lambda a, x: F.greatest(a, x))


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_c<i>``: the candidates of every generator, an array of (kind, start, end, passed, s, before, after)."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    has_digit = t.rlike("[0-9]")
    raw, gaps = {}, {}
    for i, (kind, _, signs, pattern) in enumerate(GENERATORS):
        guard = F.lit(True) if kind == "email" else has_digit
        for sign in signs:
            guard = guard & t.contains(sign)
        raw[f"_m{i}"] = F.when(guard, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = docs.withColumns(raw)
    for i, (_, _, _, pattern) in enumerate(GENERATORS):
        gaps[f"_g{i}"] = F.when(F.size(f"_m{i}") > 0, F.split(t, pattern, -1))
    out = out.withColumns(gaps)
    starts = {}
    for i in range(len(GENERATORS)):
        steps = F.zip_with(f"_g{i}", f"_m{i}", lambda g, s: (F.length(g) + F.coalesce(F.length(s), F.lit(0))).cast("long"))
        starts[f"_s{i}"] = F.when(F.size(f"_m{i}") > 0, _sums(steps))
    out = out.withColumns(starts)
    spans = {f"_c{i}": _spans(i, kind) for i, (kind, _, _, _) in enumerate(GENERATORS)}
    return out.withColumns(spans).drop(*raw, *gaps, *starts)


def _spans(i: int, kind: str) -> Column:
    def spans(h: Column) -> Column:
        def span(s: Column, k: Column) -> Column:
            before = F.get(h["gaps"], k)
            start = F.get(h["sums"], k) + F.length(before)
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), (start + F.length(s)).alias("end"), _passes(kind, s).alias("passed"),
                s.alias("s"), F.right(before, F.lit(_CONTEXT)).alias("before"), F.left(F.get(h["gaps"], k + 1), F.lit(1)).alias("after"),
            )

        return F.transform(h["found"], span)

    held = F.struct(F.col(f"_m{i}").alias("found"), F.col(f"_g{i}").alias("gaps"), F.col(f"_s{i}").alias("sums"))
    return F.when(F.size(f"_m{i}") > 0, _let(held, spans)).otherwise(F.array()).cast(f"array<{_SPAN}>")


def _scores(c: Column) -> Column:
    """Features of a candidate of any kind."""
    each = [F.array(*[f.cast("int").cast("double") for f in _features(kind, c["s"], c["before"], c["after"])]) for kind in KINDS]
    out = each[-1]
    for k in reversed(range(len(KINDS) - 1)):
        out = F.when(c["kind"] == k, each[k]).otherwise(out)
    return out


def _tree(node, f) -> Column:
    """A fitted tree as nested conditions on the feature array."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(f[split.featureIndex()] <= float(split.threshold()), _tree(node.leftChild(), f)).otherwise(_tree(node.rightChild(), f))


class Model:
    """Boosted trees and one threshold per kind; ``thresholds`` is empty if nothing could be fitted."""

    def __init__(self, trees: list | None = None, weights: list[float] | None = None, thresholds: dict[int, float] | None = None) -> None:
        self.trees, self.weights, self.thresholds = trees or [], weights or [], thresholds or {}

    def margin(self, f: Column) -> Column:
        out = F.lit(0.0)
        for root, w in zip(self.trees, self.weights, strict=True):
            out = out + w * _tree(root, f)
        return out

    def accepts(self, kind: Column, f: Column) -> Column:
        bar = F.lit(float("inf"))
        for k, t in self.thresholds.items():
            bar = F.when(kind == k, F.lit(t)).otherwise(bar)
        return self.margin(f) >= bar


def _word(words: list[str], seed: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(seed, F.lit(len(words))) + 1).cast("int"))


def _loose(kind: Column, s: Column) -> Column:
    """A base span in a form that only the loose generators take."""
    mail = F.regexp_replace(F.replace(s, F.lit("@"), F.lit(" [at] ")), r"\.(?=[A-Za-z]+$)", " [dot] ")
    d = _digits(s)
    phone = F.concat_ws("-", F.substr(d, F.length(d) - 9, F.lit(3)), F.substr(d, F.length(d) - 6, F.lit(3)), F.right(d, F.lit(4)))
    card = F.regexp_replace(d, "(?<=^(?:[0-9]{4}){1,3})", "-")
    return F.when(kind == 0, mail).when(kind == 2, card).when((kind == 3) & (F.length(d) >= 10), phone).otherwise(s)


def training_rows(base: DataFrame) -> DataFrame:
    """Candidates (s, before, after, passed, kind) with altered copies and their ``label``, as the module describes."""
    seed = F.xxhash64("s", "before")
    own = F.lit(None).cast("string")
    for k, kind in enumerate(KINDS):
        own = F.when(F.col("kind") == k, _word(CUES[kind], seed)).otherwise(own)
    other_digits = F.translate("s", "0123456789", "7305918264")
    loose, wrong = _loose(F.col("kind"), F.col("s")), _loose(F.col("kind"), other_digits)
    copies = [(F.col("s"), F.col("before"), 1.0)]
    copies += [(loose, F.concat("before", own, F.lit(gap)), 1.0) for gap in (" ", ": ")]
    copies += [(loose, F.col("before"), 1.0), (wrong, F.col("before"), 0.0)]
    copies += [(wrong, F.concat("before", _word(OTHER, seed + i), F.lit(gap)), 0.0) for i, gap in enumerate((" ", ": ", " no. "))]
    made = F.array(*[F.struct(s.alias("s"), F.right(b, F.lit(_CONTEXT)).alias("before"), F.lit(y).alias("label")) for s, b, y in copies])
    as_is = F.array(F.struct(F.col("s"), F.col("before"), F.lit(0.0).alias("label")))
    rows = base.withColumn("_v", F.explode(F.when(F.col("passed"), made).otherwise(as_is)))
    return rows.select("part", "kind", "after", "_v.*")


def isotonic(marks: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """(least score, probability) of the steps of the best rising fit to (score, weight, weight of positives)."""
    steps: list[list[float]] = []
    for m, n, good in sorted(marks):
        steps.append([m, n, good])
        while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
            _, n2, good2 = steps.pop()
            steps[-1][1] += n2
            steps[-1][2] += good2
    return [(m, good / n) for m, n, good in steps]


def example_rows(docs: DataFrame) -> DataFrame:
    """(part, kind, label, f0.., weight): the examples of all documents, equal ones counted in one row; copies of a text count once."""
    some = docs.select("text", F.xxhash64("text").alias("_o")).filter(F.col("text").rlike("[0-9@]"))
    base = F.flatten(F.array(*[F.col(f"_c{i}") for i, g in enumerate(GENERATORS) if g[1]]))
    # Only the candidates of a text are dealt by its hash, not the text.
    found = with_candidates(some).select("_o", base.alias("_b")).dropDuplicates(["_o"])
    rows = found.select(F.pmod(F.xxhash64("_o"), F.lit(2)).alias("part"), F.explode("_b").alias("c"))
    rows = training_rows(rows.select("part", "c.kind", "c.s", "c.before", "c.after", "c.passed"))
    names = [f"f{j}" for j in range(FEATURES)]
    one = F.struct("kind", "s", "before", "after")
    rows = rows.withColumn("f", _scores(one)).select("part", "kind", "label", *[F.col("f")[j].alias(n) for j, n in enumerate(names)])
    return rows.groupBy("part", "kind", "label", *names).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def fit(docs: DataFrame) -> Model:
    """Trees from the candidates of one half of all documents with a digit or an @, by a hash, thresholds from the other."""
    names = [f"f{j}" for j in range(FEATURES)]
    # Written, as the forest and the thresholds read it many times.
    rows = cut_lineage(example_rows(docs))
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("part", "kind", "label", "features", "weight", F.array(*names).alias("f"))
    learnt = rows.filter("part = 0")
    if learnt.select("label").distinct().count() < 2:
        return Model()
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, weightCol="weight", seed=7, stepSize=0.3).fit(learnt)
    model = Model([t._call_java("rootNode") for t in fitted.trees], list(fitted.treeWeights))
    marks = rows.filter("part = 1").withColumn("m", F.round(model.margin(F.col("f")), 3))
    marks = marks.groupBy("kind", "m").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("good")).collect()
    for kind in sorted({r.kind for r in marks}):
        steps = isotonic([(r.m, r.n, r.good) for r in marks if r.kind == kind])
        accepted = [m for m, p in steps if p >= ACCEPTED]
        if accepted:
            model.thresholds[kind] = min(accepted) - 5e-4
    return model


def _once(spans: Column) -> Column:
    """Sorted spans without repetition."""
    return _let(F.sort_array(spans), lambda a: F.filter(a, lambda c, k: (k == 0) | (F.get(a, F.greatest(k - 1, F.lit(0))) != c)))


def find(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``_base`` and ``_added``: arrays of (kind, start, end), by kind as listed, then start."""
    names = [c for c in docs.columns if c not in ("_base", "_added")]
    out = with_candidates(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "text"))
    span = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    base = F.concat(*[F.transform(F.filter(f"_c{i}", lambda c: c["passed"]), span) for i, g in enumerate(GENERATORS) if g[1]])
    extra = F.concat(*[F.col(f"_c{i}") for i, g in enumerate(GENERATORS) if not g[1]])
    fits = F.transform(F.filter(extra, lambda c: c["passed"] & _let(_scores(c), lambda f: model.accepts(c["kind"], f))), span)
    out = out.withColumns({"_base": F.sort_array(base), "_extra": fits}).drop(*[f"_c{i}" for i in range(len(GENERATORS))])
    # In the order of base starts and extra ends, a base span overlaps an extra one if it comes before and ends beyond its start.
    at = lambda c, key, extra: F.struct(key.alias("key"), F.lit(extra).alias("extra"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))
    events = F.sort_array(F.concat(F.transform("_base", lambda b: at(b, b["start"], 1)), F.transform("_extra", lambda c: at(c, c["end"], 0))))
    out = out.withColumn("_events", F.when(F.size("_extra") > 0, events).otherwise(F.array().cast("array<struct<key:bigint,extra:int,start:bigint,end:bigint,kind:int>>")))
    ends = _maxima(F.transform("_events", lambda e: F.when(e["extra"] == 1, e["end"]).otherwise(F.lit(0).cast("long"))))
    free = _let(ends, lambda upto: F.filter("_events", lambda e, k: (e["extra"] == 0) & (F.get(upto, k) <= e["start"])))
    free = F.when(F.size("_extra") > 0, free).otherwise(F.col("_events"))
    out = out.withColumn("_added", _once(F.transform(free, span)))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], "_base", "_added")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; ``n_chars``, if there, follows."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    found = find(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_docs"), "text"), model)
    by_start = F.sort_array(F.transform(F.concat("_base", "_added"), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    found = found.withColumn("_all", by_start).drop("_base", "_added")
    # Overlapping spans are replaced together: each begins no earlier than the furthest end before it.
    free = _let(
        _maxima(F.transform("_all", lambda c: c["end"])),
        lambda upto: F.filter(
            F.transform("_all", lambda c, k: F.struct(F.get(upto, k).alias("from"), c["start"].alias("to"), c["kind"].alias("kind"))),
            lambda p: p["from"] <= p["to"],
        ),
    )
    found = found.withColumn("_free", F.when(F.size("_all") > 0, free))

    # A piece of a long text is cut from a part of BLOCK spans, as finding a place takes time by its distance from the start.
    def cut(b: Column) -> Column:
        spans = F.slice("_free", b * BLOCK + 1, F.lit(BLOCK))

        def pieces(h: Column) -> Column:
            lo = h["p"][0]["from"]
            part = F.substr("text", (lo + 1).cast("int"), (F.element_at(h["p"], -1)["to"] - lo).cast("int"))
            one = lambda t: F.transform(
                h["p"], lambda p: F.concat(F.substr(t, (p["from"] - lo + 1).cast("int"), (p["to"] - p["from"]).cast("int")), F.get(names, p["kind"]))
            )
            return F.array_join(_let(part, one), "")

        return _let(F.struct(spans.alias("p")), pieces)

    blocks = F.sequence(F.lit(0), F.floor((F.size("_free") - 1) / BLOCK).cast("int"))
    last = F.array_max(F.transform("_all", lambda c: c["end"]))
    whole = F.concat(F.array_join(F.transform(blocks, cut), ""), F.substr("text", (last + 1).cast("int")))
    text = F.when(F.size("_all") > 0, whole).otherwise(F.col("text"))
    out = found.withColumn("_text", text).select(
        *[F.col("_text").alias("text") if c == "text" else F.col(f"_docs.`{c}`").alias(c) for c in docs.columns]
    )
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def _count(kind: int) -> Column:
    return F.size(F.filter("_base", lambda c: c["kind"] == kind)).cast("long")


@query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find(docs, fit(docs))
    return out.select(
        "doc_id",
        *[_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"),
        _listed(F.sort_array(F.concat("_base", "_added"))).alias("spans"),
    )
