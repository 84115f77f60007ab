"""Benchmark decontamination with a distributed positional inverted index; DataFrame operations only.

The index holds a posting (document, position, term) for every occurrence of a benchmark word in the corpus. It is written
once; every further step reads it instead of the texts. A window of ten consecutive benchmark words is looked up by its
rarest word: each posting of that word, less the word's place in the item, is an offset at which the item may lie in the
document. The list of the second rarest word, adjusted by its place, is intersected with these offsets, then those of all other words
at the offsets left; ten places in a row that all agree are an occurrence. With ``slack`` a word may also lie that many places beside its own: proximity
instead of phrase matches.

Defined results: NULL equals an empty text and has no words. Items without words have no window; items without an id are
counted under the id ``NULL``; rows of one item_id are one item. Repeated document rows each get their own result row, and
documents of one doc_id but different texts are kept apart.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zephra.llm.catalog import query, table
from zephra.scale import broadcast_if_small, cut_lineage

WINDOW = 10
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The end of a document is indexed like a word, so that its position is the number of words.
_END = ""
DOC = ["doc_id", "_h"]
ITEM = ["_item", "_ih"]


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; the plain function does on text without other characters."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP), "")


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def item_words(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_item, _ih, _n, _need, _j, term, word): the words of every item by place."""
    rows = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("NULL")).alias("_item"),
        text_key().alias("_ih"),
        words_of(F.col("text")).alias("_words"),
    ).distinct()
    return rows.select(
        *ITEM,
        F.size("_words").alias("_n"),
        F.least(F.size("_words"), F.lit(window)).alias("_need"),
        F.posexplode("_words").alias("_j", "word"),
    ).withColumn("term", F.xxhash64("word"))


def build_index(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Postings (doc_id, _h, pos, term) of the words given, and of the end of every document, as a written table."""
    wanted = words.select("word").unionByName(words.sparkSession.range(1).select(F.lit(_END).alias("word"))).distinct()
    wanted = broadcast_if_small(cut_lineage(wanted.withColumn("term", F.xxhash64("word"))), 200_000)
    all_words = F.concat(words_of(F.col("text")), F.array(F.lit(_END)))
    tokens = docs.select("doc_id", text_key().alias("_h"), F.posexplode(all_words).alias("pos", "word"))
    return cut_lineage(tokens.join(wanted, "word").select(*DOC, "pos", "term"))


def _end_term() -> Column:
    return F.xxhash64(F.lit(_END))


def anchors(index: DataFrame, words: DataFrame) -> DataFrame:
    """(item, _j, term, _j2, term2, _n, _need): the two rarest words of every window that has all its words in the corpus.

    A window of one word has that word twice.
    """
    counts = index.filter(F.col("term") != _end_term()).groupBy("term").agg(F.count(F.lit(1)).alias("_c"))
    known = words.join(broadcast_if_small(cut_lineage(counts), 200_000), "term", "left").fillna(0, ["_c"])
    # Whole windows have the full frame; an item shorter than that is one window, at its first word.
    longest = words.agg(F.max("_need")).first()[0] or 1
    ahead = Window.partitionBy(*ITEM).orderBy("_j").rowsBetween(0, longest - 1)
    rare = known.withColumn("_a", F.sort_array(F.collect_list(F.struct("_c", "_j", "term")).over(ahead)))
    rare = rare.filter((F.col("_j") <= F.col("_n") - F.col("_need")) & (F.col("_a")[0]["_c"] > 0))
    first, second = F.col("_a")[0], F.coalesce(F.get("_a", F.lit(1)), F.col("_a")[0])
    return rare.select(
        *ITEM, first["_j"].alias("_j"), first["term"].alias("term"), second["_j"].alias("_j2"), second["term"].alias("term2"), "_n", "_need"
    ).distinct()


def runs(index: DataFrame, words: DataFrame, slack: int = 0) -> DataFrame:
    """(doc_id, _h, _item, pos): every document word inside an occurrence of a window; rows may repeat over items' copies."""
    words = cut_lineage(words)
    found = cut_lineage(anchors(index, words))

    def around(df: DataFrame, name: str, value: Column) -> DataFrame:
        """``value`` and, for proximity, all values within ``slack`` of it."""
        return df.withColumn(name, F.explode(F.array(*[value + e for e in range(-slack, slack + 1)])) if slack else value)

    def offsets(place: str, term: str, beside: bool) -> DataFrame:
        """Where the item would begin, by the postings of one word of each window."""
        pairs = broadcast_if_small(found.withColumn("_t", F.col(term)), 100_000)
        at, begin = index.join(pairs, index["term"] == pairs["_t"]), F.col("pos") - F.col(place)
        at = around(at, "_off", begin) if beside else at.withColumn("_off", begin)
        return at.select(*DOC, *ITEM, "_off", "_j", "_j2", "_n", "_need")

    # The rarest words' lists are intersected first; the others are read only where these two agree.
    at, also = offsets("_j", "term", False), offsets("_j2", "term2", True)
    same = at["doc_id"].eqNullSafe(also["doc_id"])
    for c in ("_h", *ITEM, "_off", "_j", "_j2"):
        same = same & (at[c] == also[c])
    at = at.join(also, same, "left_semi").select(*DOC, *ITEM, "_off", F.col("_j").alias("_a"), "_n", "_need")
    at = cut_lineage(at.distinct())
    # Only places that share a window with the anchor can be part of its occurrences.
    reach = F.sequence(
        F.greatest(F.lit(0), F.col("_a") - F.col("_need") + 1), F.least(F.col("_n") - 1, F.col("_a") + F.col("_need") - 1)
    )
    places = at.select(*DOC, *ITEM, "_off", "_need", F.explode(reach).alias("_j")).distinct()
    terms = words.select(*ITEM, "_j", "term")
    expected = places.join(broadcast_if_small(terms, 200_000), [*ITEM, "_j"])
    expected = around(expected, "pos", F.col("_off") + F.col("_j"))
    touched = broadcast_if_small(at.select("doc_id", "_h").distinct(), 500_000)
    lists = index.join(touched, index["doc_id"].eqNullSafe(touched["doc_id"]) & (index["_h"] == touched["_h"]), "left_semi")
    same = (
        expected["doc_id"].eqNullSafe(lists["doc_id"]) & (expected["_h"] == lists["_h"])
        & (expected["pos"] == lists["pos"]) & (expected["term"] == lists["term"])
    )
    agree = expected.join(lists, same, "left_semi").select(*DOC, *ITEM, "_off", "_need", "_j")
    if slack:
        agree = agree.distinct()
    along = Window.partitionBy(*DOC, *ITEM, "_off")
    islands = agree.withColumn("_run", F.col("_j") - F.row_number().over(along.orderBy("_j")))
    long = islands.withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy(*DOC, *ITEM, "_off", "_run")))
    return long.filter(F.col("_len") >= F.col("_need")).select(*DOC, "_item", (F.col("_off") + F.col("_j")).alias("pos"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = 0) -> DataFrame:
    """(doc_id, _h, n_words, n_hit, n_items, items_sha256, contaminated) per row of ``docs``."""
    words = item_words(items, window)
    index = build_index(docs.select("doc_id", "text"), words)
    hits = cut_lineage(runs(index, words, slack))
    n_hit = hits.select(*DOC, "pos").distinct().groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_hit"))
    named = hits.select(*DOC, "_item").distinct().groupBy(*DOC).agg(F.sort_array(F.collect_list("_item")).alias("_items"))
    ends = index.filter(F.col("term") == _end_term()).select(*DOC, F.col("pos").cast("long").alias("n_words"))

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({"doc_id": "_rid", "_h": "_rh"})
        return left.join(right, left["doc_id"].eqNullSafe(right["_rid"]) & (left["_h"] == right["_rh"]), "left").drop("_rid", "_rh")

    out = joined(joined(ends, n_hit), named)
    none = F.array().cast("array<string>")
    return out.select(
        *DOC,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("_items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("_items", none), ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` in which no window of ``items`` occurs."""
    words = item_words(items, window)
    hits = runs(build_index(docs.select("doc_id", "text"), words), words)
    bad = cut_lineage(hits.select(F.col("doc_id").alias("_bad_id"), F.col("_h").alias("_bad_h")).distinct())
    bad = broadcast_if_small(bad, 500_000)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (text_key() == bad["_bad_h"]), "left_anti")


_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), iw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), iwin AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS s FROM iw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM iwin
), dwin AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM dw, sizes WHERE len(w) >= k)
), hit AS (SELECT d.doc_id, d.s, d.k, i.item_id FROM dwin d JOIN iwin i ON d.win = i.win AND d.k = i.k
), pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS p FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS h
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op3_decontamination", _SQL)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_h")
