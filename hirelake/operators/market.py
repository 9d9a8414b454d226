"""Pay and skill-demand questions over the ingested history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from hirelake.operators.freshness import current_openings, latest
from hirelake.operators.skills import jobs_asking
from hirelake.plans.quantiles import exact_percentiles
from hirelake.session import materialize

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
STEP = {"day": "1 DAY", "week": "7 DAYS", "month": "1 MONTH", "quarter": "3 MONTHS", "year": "1 YEAR"}


def comp_by(jobs: DataFrame, dims: list[str], comp: str = "comp", probs: dict[str, float] | None = None) -> DataFrame:
    return exact_percentiles(jobs, dims, comp, probs or QUARTILES)


def comp_cube(jobs: DataFrame, comp: str = "comp", probs: dict[str, float] | None = None) -> DataFrame:
    """Comp per (role, location), per role, per location and overall.

    ``grouping`` is the grouping id: 0 for both, 1 without location, 2 without role, 3 overall.
    """
    role, place, none = F.col("role"), F.col("location"), F.lit(None).cast("string")
    level = lambda r, p, g: F.struct(
        r.alias("role"), p.alias("location"), F.lit(g).alias("grouping"))
    levels = F.array(level(role, place, 0), level(role, none, 1), level(none, place, 2), level(none, none, 3))
    sets = jobs.select(F.explode(levels).alias("s"), comp).select("s.*", comp)
    return exact_percentiles(sets, ["role", "location", "grouping"], comp, probs or QUARTILES)


def comp_trend(jobs: DataFrame, bucket: str = "month", by: str = "role", at: str = "seen_at",
               comp: str = "comp") -> DataFrame:
    """Median comp per period and its change from the period just before; null where that has none."""
    cut = jobs.select(by, F.date_trunc(bucket, at).alias("period"), comp)
    medians = exact_percentiles(cut, [by, "period"], comp, {"p50": 0.5})
    order = Window.partitionBy(by).orderBy("period")  # one row per period
    just_before = F.date_trunc(bucket, F.col("period") - F.expr("INTERVAL 1 DAY"))
    return medians.withColumn("change", F.when(
        F.lag("period").over(order) == just_before, F.col("p50") - F.lag("p50").over(order)))


def skill_demand(jobs: DataFrame, row_id: str = "posting_id", unique: bool = False) -> DataFrame:
    """Postings that ask for each skill; ``unique`` when every posting has one row."""
    return jobs_asking(jobs, [], row_id, unique).withColumnRenamed("n_asking", "n_jobs")


def skill_trend(jobs: DataFrame, bucket: str = "quarter", at: str = "seen_at",
                row_id: str = "posting_id") -> DataFrame:
    """Share of each period's postings asking for a skill, its change, and a three-period mean.

    A skill has a row for every period from its first one to the last of all: nobody asking
    is a share of 0, and a period without postings has no share.
    """
    cut = jobs.select(row_id, "skills", F.date_trunc(bucket, at).alias("period"))
    totals = materialize(cut.groupBy("period").agg(F.count_distinct(row_id).alias("n_jobs")), "periods")
    asked = materialize(jobs_asking(cut, ["period"], row_id, unique=False), "asked")
    until = F.lit(latest(totals, "period"))
    spine = asked.groupBy("skill").agg(F.min("period").alias("since")).select(
        "skill", F.explode(F.sequence("since", until, F.expr(f"INTERVAL {STEP[bucket]}"))).alias("period"))
    none = F.lit(0).cast("long")
    share = (
        spine.join(totals, "period", "left").join(asked, ["skill", "period"], "left")
        .withColumns({"n_asking": F.coalesce("n_asking", none), "n_jobs": F.coalesce("n_jobs", none)})
        .withColumn("share", F.when(F.col("n_jobs") > 0, F.col("n_asking") / F.col("n_jobs")))
    )
    order = Window.partitionBy("skill").orderBy("period")  # one row per period
    return share.withColumn("change", F.col("share") - F.lag("share").over(order)).withColumn(
        "share_mean3", F.avg("share").over(order.rowsBetween(-2, 0)))


def role_pay_now(jobs: DataFrame, role: str, as_of: datetime, ttl_days: float, comp: str = "comp_max") -> DataFrame:
    """What a role pays now: comp of its current openings."""
    return comp_by(current_openings(jobs, as_of, ttl_days).where(F.col("role") == role), ["role"], comp)


def top_skills(jobs: DataFrame, n: int, row_id: str = "posting_id", unique: bool = False) -> DataFrame:
    """The ``n`` most demanded skills of each role; ties by skill."""
    counts = jobs_asking(jobs, ["role"], row_id, unique).withColumnRenamed("n_asking", "n_jobs")
    order = Window.partitionBy("role").orderBy(F.desc("n_jobs"), "skill")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
