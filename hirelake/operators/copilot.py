"""Skill gaps, tailoring, letters and the application tracker."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from hirelake.operators.embed import LLMProvider, generate
from hirelake.operators.skills import jobs_asking
from hirelake.plans.quantiles import exact_percentiles
from hirelake.plans.series import with_neighbour
from hirelake.session import materialize

# Stages of an application, in order, and the moves between them.
STATUSES = ["saved", "applied", "interviewing", "offer", "rejected"]
CLOSED = ["offer", "rejected"]
ALLOWED_MOVES = [
    ("saved", "applied"),
    ("applied", "interviewing"),
    ("applied", "rejected"),
    ("interviewing", "offer"),
    ("interviewing", "rejected"),
]
KEYS = ["profile_id", "job_id"]


def role_requirements(jobs: DataFrame, role: str = "role", row_id: str = "posting_id",
                      unique: bool = False) -> DataFrame:
    """Share of a role's postings that ask for each skill.

    Pass ``unique`` when every posting has one row; the counts then need no distinct.
    """
    n = F.count(F.lit(1)) if unique else F.count_distinct(row_id)
    totals = jobs.groupBy(role).agg(n.alias("n_jobs"))
    asked = jobs_asking(jobs, [role], row_id, unique)
    return asked.join(totals, role).withColumn("share", F.col("n_asking") / F.col("n_jobs"))


def skill_gap(targets: DataFrame, owned: DataFrame, requirements: DataFrame, min_share: float) -> DataFrame:
    """Skills a profile lacks for the role it aims at, most demanded first.

    ``targets`` is ``profile_id, role`` and ``owned`` is ``profile_id, skill``: an equi-join on
    the role, never profiles against everything.
    """
    needed = requirements.where(F.col("share") >= min_share).select("role", "skill", "share")
    order = Window.partitionBy("role").orderBy(F.desc("share"), "skill")  # one row per skill
    # Written, so that its size is known: broadcast if small, else AQE splits a hot role.
    ranks = materialize(needed.withColumn("demand_rank", F.row_number().over(order)), "demand")
    return targets.join(ranks, "role").join(
        owned.select("profile_id", "skill"), ["profile_id", "skill"], "left_anti")


def skill_lift(skills: DataFrame, cohort: DataFrame, good: str, min_support: int,
               row_id: str = "posting_id") -> DataFrame:
    """How much more often the good part of a cohort has a skill than the whole of it.

    ``skills`` is distinct ``row_id, skill``; ``cohort`` is ``row_id`` with the boolean ``good``.
    """
    n_all, n_good = cohort.agg(F.count(F.lit(1)), F.count_if(good)).first()
    counts = skills.join(cohort, row_id).groupBy("skill").agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(good).alias("n_cohort"))
    lift = (F.col("n_cohort") / float(n_good or 1)) / (F.col("n_all") / float(n_all or 1))
    return counts.where(F.col("n_all") >= min_support).withColumn("lift", lift)


def tailor(matches: DataFrame, term_counts: DataFrame, few: int) -> DataFrame:
    """Per match: job skills to add to the resume, and shared ones it mentions fewer than ``few`` times.

    ``term_counts`` is ``profile_id, skill, mentions``.
    """
    wanted = matches.select(*KEYS, F.explode("job_skills").alias("skill")).distinct()
    joined = wanted.join(term_counts, ["profile_id", "skill"], "left")
    mentions = F.coalesce("mentions", F.lit(0))
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("skill"))))
    return joined.groupBy(*KEYS).agg(
        pick(mentions == 0).alias("add"),
        pick((mentions > 0) & (mentions < few)).alias("emphasize"),
    )


def draft_letters(matches: DataFrame, provider: LLMProvider) -> DataFrame:
    """One draft letter per explained match."""
    strengths = F.when(F.col("n_overlap") > 0, F.array_join("overlap", ", ")).otherwise("a related background")
    prompt = F.format_string("I would like to apply for position %s. I bring %s.",
                             F.col("job_id").cast("string"), strengths)
    return generate(matches.withColumn("prompt", prompt), "prompt", provider, "letter")


# ---- application tracker ---------------------------------------------------------

def current_status(events: DataFrame) -> DataFrame:
    latest = F.max(F.struct("at", "event_id", "status")).alias("_e")
    return events.groupBy(*KEYS).agg(latest).select(
        *KEYS, F.col("_e.status").alias("status"), F.col("_e.at").alias("since"))


def status_timeline(events: DataFrame) -> DataFrame:
    """First time in each status, one column per status; the list is fixed, so no extra pass."""
    return events.groupBy(*KEYS).agg(
        *[F.min(F.when(F.col("status") == s, F.col("at"))).alias(s) for s in STATUSES])


def bad_transitions(events: DataFrame, allowed: list[tuple[str, str]] | None = None) -> DataFrame:
    """Events that follow the event before them by no allowed move; a repeat is not allowed either."""
    spark = events.sparkSession
    moves = spark.createDataFrame(allowed or ALLOWED_MOVES, "before string, status string")
    steps = with_neighbour(events, KEYS, "at", "event_id", "status", "before").where(
        F.col("before").isNotNull())
    return steps.join(moves, ["before", "status"], "left_anti")


def due_reminders(events: DataFrame, as_of: datetime, after_days: float) -> DataFrame:
    """Open applications without news for ``after_days``."""
    return current_status(events).where(
        ~F.col("status").isin(CLOSED) & (F.col("since") <= F.lit(as_of - timedelta(days=after_days))))


def pipeline_counts(events: DataFrame) -> DataFrame:
    return current_status(events).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def stage_durations(events: DataFrame, probs: dict[str, float] | None = None) -> DataFrame:
    """Seconds spent in each status before the next event: count and percentiles."""
    steps = with_neighbour(events, KEYS, "at", "event_id", "at", "next_at", forward=True)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    spent = steps.where(F.col("next_at").isNotNull()).select(
        "status", ((micros("next_at") - micros("at")) / 1e6).alias("seconds"))
    return exact_percentiles(spent, ["status"], "seconds", probs or {"p50": 0.5, "p90": 0.9})
