"""Raw payloads to one posting schema, and filters over it."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hirelake.functions import text as tx


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All configured sources as one feed; a column a source lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def map_payload(df: DataFrame, mapping: dict[str, str], payload: str = "payload") -> DataFrame:
    """Add one column per mapped JSON path. Bad JSON or a missing path gives null.

    A path may carry a type after a colon, as in ``"$.salary.min:double"``.
    """
    parsed = df.withColumn("_variant", F.try_parse_json(payload))
    fields = {}
    for column, spec in mapping.items():
        path, _, kind = spec.partition(":")
        fields[column] = F.try_variant_get("_variant", path, kind or "string")
    return parsed.withColumns(fields).drop("_variant")


def normalize(raw: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The single posting schema: one narrow projection, no shuffle."""
    mapped = map_payload(raw, mapping)
    for column in ("title", "company", "location", "comp", "description"):
        if column not in mapped.columns:
            mapped = mapped.withColumn(column, F.lit(None).cast("string"))
    # Values that several columns read are named first, so each is computed once.
    named = mapped.withColumns(
        {"_title_norm": tx.norm_title("title"), "_comp": tx.parse_comp("comp")})
    return named.select(
        tx.posting_key("source", "external_id").alias("posting_id"),
        "source", "external_id",
        tx.canonical_url("url").alias("canonical_url"),
        F.trim("title").alias("title"),
        F.col("_title_norm").alias("title_norm"),
        F.trim("company").alias("company"),
        tx.norm_company("company").alias("company_norm"),
        F.lower(F.trim("location")).alias("location"),
        tx.seniority("_title_norm").alias("seniority"),
        F.col("_comp.min").alias("comp_min"),
        F.col("_comp.max").alias("comp_max"),
        "description", "fetched_at",
    )


def norm_location(df: DataFrame, column: str, aliases: DataFrame, out: str = "location_norm") -> DataFrame:
    """Canonical place by alias table ``alias, place``; unknown places keep their tidy form.

    No broadcast hint: Catalyst broadcasts the table when its size allows, and
    AQE splits a hot place when it does not.
    """
    tidy = F.trim(F.regexp_replace(F.lower(column), r"[\s_,]+", " "))
    alias = aliases.select(F.col("alias").alias("_alias"), F.col("place").alias("_place"))
    return (
        df.withColumn("_tidy", tidy)
        .join(alias, F.col("_tidy") == F.col("_alias"), "left")
        .withColumn(out, F.coalesce("_place", "_tidy"))
        .drop("_tidy", "_alias", "_place")
    )


def apply_filters(
    df: DataFrame, *, location: str | list[str] | None = None, comp_floor: float | None = None,
    seniority: str | list[str] | None = None, seen_after: datetime | None = None,
) -> DataFrame:
    """Plain predicates on plain columns, so all of them reach the Parquet scan."""
    conditions: list[Column] = []
    for column, wanted in (("location", location), ("seniority", seniority)):
        if wanted is not None:
            conditions.append(F.col(column).isin([wanted] if isinstance(wanted, str) else list(wanted)))
    if comp_floor is not None:
        conditions.append(F.col("comp_max") >= comp_floor)
    if seen_after is not None:
        conditions.append(F.col("last_seen") > F.lit(seen_after))
    return reduce(lambda d, c: d.where(c), conditions, df)


def job_detail(jobs: DataFrame, members: DataFrame, job_id: str) -> DataFrame:
    """One job with all of its postings."""
    return jobs.where(F.col("job_id") == job_id).join(
        members.where(F.col("job_id") == job_id), "job_id", "left"
    )
