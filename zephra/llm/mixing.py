"""Mixing sources to target weights by iterative proportional fitting; DataFrame operations only.

Documents are summed to cells (source, language, topic) of token counts. Raking multiplies the cells by one factor per
source, language and topic in turn, until the margins are the target shares; a factor table is one grouped sum over the
cells. The weight of a cell against its share of the corpus, times the part of all tokens wanted, is the probability of its
documents; where it exceeds 1 the rest stays as a weight, so weighted tokens keep to the targets. Sampling compares a hash
of doc_id with the probability, so it is repeatable and independent of partitions.

Defined results: NULL source, language or topic is a category of its own (``NULL``); documents without a token have no
weight and are not drawn; repeated rows are drawn together. An empty table gives an empty result. Columns of the names of
the result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zephra.llm.catalog import query, table
from zephra.scale import broadcast_if_small, cut_lineage, has_at_most

MARGINS = ["_source", "_lang", "_topic"]
ROUNDS = 8
FLATTEN = 0.5  # default targets: shares of the corpus to this power
BUDGET = 0.5
SEED = "mix-1"


def _category(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL"))


def _with_margins(docs: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")
    return docs.withColumns({m: _category(n) for m, n in zip(MARGINS, names, strict=True)} | {"n_tokens": tokens})


def flattened_targets(cells: DataFrame, power: float = FLATTEN) -> dict[str, DataFrame]:
    """Per margin (value, _target): token shares to the power ``power``, scaled to 1."""
    out = {}
    for m in MARGINS:
        mass = cells.groupBy(m).agg(F.sum("_t").alias("_m")).filter("_m > 0").withColumn("_m", F.pow(F.col("_m"), power))
        out[m] = mass.select(m, (F.col("_m") / mass.agg(F.sum("_m")).scalar()).alias("_target"))
    return out


def raked(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (margins, _t) with ``_w``: the raked share of a cell over its share of the tokens.

    Only the factor tables change, one row per value of a margin; each is written, so that plans stay short. Their sizes are
    those of the targets, looked up once: a job more for each of the 24 steps would stay in the driver's memory.
    """
    base = cut_lineage(cells.withColumn("_f", F.col("_t") / cells.agg(F.sum("_t")).scalar()))
    goal = {m: cut_lineage(targets[m]) for m in MARGINS}
    few = {m: has_at_most(goal[m], 100_000) for m in MARGINS}
    factors = {m: goal[m].select(m, F.lit(1.0).alias(f"_x{m}")) for m in MARGINS}

    def scaled(skip: str | None) -> DataFrame:
        out, share = base, F.col("_f")
        for m in MARGINS:
            if m != skip:
                out = out.join(F.broadcast(factors[m]) if few[m] else factors[m], m)
                share = share * F.col(f"_x{m}")
        return out.withColumn("_g", share)

    for _ in range(rounds):
        for m in MARGINS:
            now = scaled(m).groupBy(m).agg(F.sum("_g").alias("_g"))
            made = goal[m].join(now, m).select(m, (F.col("_target") / F.col("_g")).alias(f"_x{m}"))
            factors[m] = cut_lineage(made.coalesce(1) if few[m] else made)
    return scaled(None).select(*MARGINS, "_t", (F.col("_g") / F.col("_f")).alias("_w"))


def sample(
    docs: DataFrame,
    names: tuple[str, str, str] = ("source", "lang", "topic"),
    targets: dict[str, DataFrame] | None = None,
    budget: float = BUDGET,
    rounds: int = ROUNDS,
    seed: str = SEED,
) -> DataFrame:
    """Documents drawn, with n_tokens, probability and weight. ``targets`` has (value, _target) under each of ``MARGINS``."""
    rows = _with_margins(docs, names)
    cells = cut_lineage(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("_t")).filter("_t > 0"))
    fitted = cut_lineage(raked(cells, targets or flattened_targets(cells), rounds).select(*MARGINS, "_w"))
    rows = rows.join(broadcast_if_small(fitted, 100_000), MARGINS)
    ratio = F.col("_w") * budget
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10)
    rows = rows.withColumns({"probability": F.least(F.lit(1.0), ratio), "weight": F.greatest(F.lit(1.0), ratio)})
    picked = rows.filter((F.col("n_tokens") > 0) & (drawn.cast("double") / 2.0**32 < F.col("probability")))
    return picked.drop(*MARGINS, "_w")


def with_topic(docs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``docs`` with the cluster label of their embedding as ``topic``; NULL without one."""
    labels = embeddings.groupBy(F.col("vec_id").alias("_vec")).agg(F.min("label").alias("topic"))
    return docs.drop("topic").join(labels, docs["doc_id"] == labels["_vec"], "left").drop("_vec")


def _sql() -> str:
    ctes = [r"""WITH d AS (
  SELECT doc_id, coalesce(source, 'NULL') AS source, coalesce(lang, 'NULL') AS lang, coalesce(CAST(label AS VARCHAR), 'NULL') AS topic,
    len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS n
  FROM documents LEFT JOIN (SELECT vec_id, min(label) AS label FROM embeddings GROUP BY vec_id) ON doc_id = vec_id
), c AS (SELECT source, lang, topic, sum(n) AS t FROM d GROUP BY ALL HAVING sum(n) > 0
), b0 AS MATERIALIZED (SELECT source, lang, topic, t, t / (SELECT sum(t) FROM c) AS f, t / (SELECT sum(t) FROM c) AS g FROM c)"""]
    short = ["source", "lang", "topic"]
    for m in short:
        ctes.append(
            f"t_{m} AS MATERIALIZED (SELECT {m}, pow(sum(t), {FLATTEN}) / (SELECT sum(x) FROM (SELECT pow(sum(t), {FLATTEN}) AS x FROM c GROUP BY {m})) AS a"
            f" FROM c GROUP BY {m})"
        )
    k = 0
    for _ in range(ROUNDS):
        for m in short:
            ctes.append(
                f"b{k + 1} AS MATERIALIZED (SELECT b.source, b.lang, b.topic, t, f, g * a / s AS g FROM b{k} b JOIN t_{m} USING ({m})"
                f" JOIN (SELECT {m}, sum(g) AS s FROM b{k} GROUP BY {m}) USING ({m}))"
            )
            k += 1
    return ",\n".join(ctes) + f"""
SELECT doc_id, source, lang, topic, CAST(n AS BIGINT) AS n_tokens, round(least(1.0, {BUDGET} * g / f), 6) AS probability,
  round(greatest(1.0, {BUDGET} * g / f), 6) AS weight
FROM d JOIN b{k} USING (source, lang, topic)
WHERE n > 0 AND CAST('0x' || substr(md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < least(1.0, {BUDGET} * g / f)
"""


@query("op7_mixing", _sql())
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    out = sample(with_topic(docs, table(spark, sf_dir, "embeddings").select("vec_id", "label")))
    names = [_category(n).alias(n) for n in ("source", "lang", "topic")]
    return out.select("doc_id", *names, "n_tokens", F.round("probability", 6).alias("probability"), F.round("weight", 6).alias("weight"))
