"""The earliest similar row of each row, found where rows meet.

Rows meet at points: a bucket of a hash, a rare shingle. Pairing all that meet would be
quadratic in a group of copies, so at each point rows are tested against its first members only,
and the next wave takes the next members, for rows that may still find an earlier match. A
group of copies is settled by its first member; a point of few members, ``SMALL`` at most, is settled by
one wave; and the waves go on until nothing is left
to test: afterwards every row has been tested against each earlier row it meets, up to its match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from hirelake.session import materialize

SMALL = 32


def earliest_matches(members: DataFrame, verify: Callable[[DataFrame], DataFrame], leaders: int = 4) -> DataFrame:
    """``id, dup_of, score`` from distinct ``point, id``. ``verify`` takes pairs ``id, other`` and gives
    those that match, with a ``score``.

    The first members of a point come from a limit that Spark applies in every task before the
    shuffle, and are kept as one short list per point. Rows join that list, so a crowded point is
    a skewed join with one row on the other side, which Spark splits over tasks at run time.
    """
    shared = members.groupBy("point").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    waiting = materialize(members.join(shared, "point").select("point", "id", "n"), "members")
    testers = waiting.select("point", "id")
    found, width = None, leaders
    while not waiting.isEmpty():
        first = Window.partitionBy("point").orderBy("id")
        nth = F.col("nth")
        heads = materialize(waiting.withColumn("nth", F.row_number().over(first)).where(
            (nth <= max(width, SMALL)) & ((F.col("n") <= SMALL) | (nth <= width))).groupBy("point").agg(
            F.sort_array(F.collect_list("id")).alias("others")), "heads")
        met = testers.join(heads, "point")
        if found is not None:
            met = met.join(found.select("id", "dup_of"), "id", "left")
        # Only a member before the row's match so far can make a difference.
        until = F.col("id") if found is None else F.coalesce("dup_of", "id")
        pairs = materialize(met.withColumn("until", until).select(
            "id", F.explode(F.filter("others", lambda o: o < F.col("until"))).alias("other")).distinct(), "pairs")
        hits = verify(pairs).select("id", F.col("other").alias("dup_of"), "score")
        found = materialize((hits if found is None else hits.unionByName(found)).groupBy("id").agg(
            F.min(F.struct("dup_of", "score")).alias("m")).select("id", "m.dup_of", "m.score"), "matches")
        testers = materialize(
            testers.join(heads.select("point", F.element_at("others", -1).alias("last")), "point")
            .join(found.select("id", "dup_of"), "id", "left").withColumn("until", F.coalesce("dup_of", "id"))
            .where(F.col("until") > F.col("last")).select("point", "id", "until", "last"), "testers")
        reach = testers.groupBy("point").agg(F.max("until").alias("until"), F.max("last").alias("last"))
        testers = testers.select("point", "id")
        waiting = materialize(waiting.join(reach, "point").where(
            (F.col("id") > F.col("last")) & (F.col("id") < F.col("until"))).select("point", "id", "n"), "waiting")
        width *= 4
    if found is None:
        found = testers.select("id", F.col("id").alias("dup_of"), F.lit(1.0).alias("score")).limit(0)
    return found
