"""Mixing sources to target weights by fractional repetition.

Tokens are summed per source, a target per source gives its repetition rate, and each
document comes floor(rate) times plus one more with probability equal to the fraction,
drawn from a hash of its id. Nulls: a null text has size 0, a null source is a source of
its own and comes last, a null id draws as the text ``null``. Rows that repeat draw alike.
A source without words has target 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hirelake.llm.words import WORD

# Weights by place among the sources, the share and the repeat limit.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from one row per source.

    Sources in order of ``most * size / weight`` stop at their limit one after the other
    while the level, the rest of the words over the rest of the weights, is above that
    ratio. The windows see one row per source, never documents.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("_at", F.row_number().over(named) - 1).withColumn(
        "_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    ).withColumn("_limit", F.col("source_size").cast("double") * most)
    order = Window.orderBy(F.col("_limit") / F.col("_weight"), "_at")
    before, rest = (order.rowsBetween(Window.unboundedPreceding, -1),
                    order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = weighted.select(
        "source", "source_size", "_weight", "_limit", F.row_number().over(order).alias("_k"),
        ((F.sum("source_size").over(every) * share - F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
         / F.sum("_weight").over(rest)).alias("_level"))
    free = F.when(F.col("_limit") > F.col("_level") * F.col("_weight"), F.struct("_k", "_level"))
    everywhere = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = levels.withColumn("_free", F.min(free).over(everywhere))
    return first.select(
        "source", "source_size",
        F.when(F.col("_free").isNull() | (F.col("_k") < F.col("_free._k")), F.col("_limit"))
        .otherwise(F.col("_free._level") * F.col("_weight")).alias("target"))


def planned(docs: DataFrame, seed: int = 17, **mix) -> DataFrame:
    """``docs`` with ``_size`` (counted from the text unless it is given), ``_source_size``,
    ``_target`` and ``_copies``."""
    sized = docs if "_size" in docs.columns else docs.withColumn("_size", word_count())
    per_source = targets(sized.groupBy("source").agg(F.sum("_size").alias("source_size")), **mix).select(
        F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(2**52)
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    return sized.join(per_source, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_rate", rate).withColumn(
        "_copies", (F.floor("_rate") + F.when(draw < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)).cast("int")
    ).drop("_s", "_rate")


def mixing_plan(docs: DataFrame, **mix) -> DataFrame:
    """What the mix takes of every document."""
    lean = planned(docs.select("doc_id", "text", "source"), **mix)
    return lean.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).cast("long").alias("taken"))


def mixed(docs: DataFrame, **mix) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns, which travel
    as a struct so that none can clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = planned(docs.select(row.alias("row"), "doc_id", "source", word_count().alias("_size")), **mix)
    return rows.where(F.col("_copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, 2 * source_size::DOUBLE AS lim, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS spot,
         [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM per),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY lim / w, spot) AS k FROM weighted),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(lim) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ordered),
free AS (SELECT min(k) AS k FROM levels WHERE lim > level * w),
targets AS (
  SELECT l.source, l.source_size,
         CASE WHEN f.k IS NULL OR l.k < f.k THEN l.lim
              ELSE (SELECT x.level FROM levels x, free y WHERE x.k = y.k) * l.w END AS target
  FROM levels l, free f),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
