"""Job-domain views over the given tables.

Operators take plain DataFrames; these views give them postings, sightings,
profiles, applications and ops events derived from whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hirelake.functions.text import ngrams, tokens
from hirelake.session import spread

# Application status for each event type.
STATUS_OF_EVENT = {
    "view": "saved",
    "click": "applied",
    "signup": "interviewing",
    "purchase": "offer",
    "error": "rejected",
}
# How each region's boards write company names.
COMPANY_STYLE = {0: ", Inc.", 1: " LLC", 2: " Ltd.", 3: " GmbH"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _id(*cols: str):
    return F.concat_ws("-", *[F.col(c).cast("string") for c in cols])


def observations(spark, sf) -> DataFrame:
    return as_observations(table(spark, sf, "lineitem"))


def as_observations(lineitem: DataFrame) -> DataFrame:
    """One sighting of a posting per row."""
    return lineitem.select(
        _id("l_partkey", "l_suppkey").alias("posting_id"),
        F.col("l_suppkey").cast("string").alias("source"),
        F.col("l_shipdate").alias("seen_at"),
        F.col("l_extendedprice").alias("comp"),
    )


def job_parts(spark, sf) -> DataFrame:
    """Attributes of the job behind an external id."""
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.concat(
            F.when(size <= 12, "Jr. ").when(size <= 25, "").when(size <= 38, "Sr. ").otherwise("Lead "),
            F.col("p_name"),
        ).alias("title"),
        F.when(size <= 12, "junior").when(size <= 25, "mid").when(size <= 38, "senior")
        .otherwise("lead").alias("seniority"),
        F.col("p_brand").alias("company"),
        F.col("p_type").alias("role"),
        F.split("p_name", " ").alias("skills"),
    )


def with_nation(df: DataFrame, spark, sf, supplier_key: str) -> DataFrame:
    """Add the nation key of a source: a number, so that rows stay narrow while they are shuffled."""
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return df.join(supplier, F.col(supplier_key) == F.col("s_suppkey"))


def with_names(df: DataFrame, spark, sf) -> DataFrame:
    """Name the nation and region of a source. One dimension at a time: each join then sees the
    true size of a scan and is broadcast or shuffled accordingly."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey", F.col("n_name").alias("location"))
    region = table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("region"))
    return (
        df.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )


def with_place(df: DataFrame, spark, sf, supplier_key: str) -> DataFrame:
    """Add the location of a source."""
    return with_names(with_nation(df, spark, sf, supplier_key), spark, sf)


def postings(spark, sf) -> DataFrame:
    """Clean postings with their seen range and comp range."""
    seen = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.min("l_shipdate").alias("first_seen"),
        F.max("l_shipdate").alias("last_seen"),
        F.count(F.lit(1)).alias("n_seen"),
        F.min("l_extendedprice").alias("comp_min"),
        F.max("l_extendedprice").alias("comp_max"),
    )
    # Both joins that may shuffle come while a row is keys and numbers; texts are added by the last of them.
    jobs = with_nation(seen, spark, sf, "l_suppkey").join(job_parts(spark, sf), F.col("l_partkey") == F.col("p_partkey"))
    return with_names(jobs, spark, sf).select(
        _id("l_partkey", "l_suppkey").alias("posting_id"),
        F.col("l_suppkey").cast("string").alias("source"),
        F.col("l_partkey").cast("string").alias("external_id"),
        "title", "company", "role", "seniority", "location", "region", "r_regionkey", "skills",
        "first_seen", "last_seen", "n_seen", "comp_min", "comp_max",
    )


def raw_postings(spark, sf) -> DataFrame:
    """The same postings as a board would send them: untidy fields in a JSON payload."""
    style = F.col("r_regionkey")
    company = F.col("company")
    suffix = F.lit("")
    for key, ending in COMPANY_STYLE.items():
        suffix = F.when(style == key, ending).otherwise(suffix)
    thousands = lambda c: F.floor(F.col(c) / 1000).cast("string")
    return postings(spark, sf).select(
        "source", "external_id",
        F.concat(F.lit("https://www.Board"), "source", F.lit(".example.com/jobs/"), "external_id",
                 F.lit("/?utm_source=feed")).alias("url"),
        F.to_json(F.struct(
            F.when(style == 4, F.upper("title")).otherwise(F.col("title")).alias("position"),
            F.concat(company, suffix).alias("employer"),
            F.struct(F.concat(F.lit("  "), "location").alias("name")).alias("place"),
            F.concat(F.lit("$"), thousands("comp_min"), F.lit("k - $"), thousands("comp_max"),
                     F.lit("k")).alias("salary"),
            F.concat(F.lit("We need: "), F.array_join("skills", ", ")).alias("body"),
        )).alias("payload"),
        F.date_trunc("month", "last_seen").cast("timestamp_ntz").alias("fetched_at"),
    )


# Where the normalized fields sit in the payload above.
PAYLOAD_MAPPING = {
    "title": "$.position",
    "company": "$.employer",
    "location": "$.place.name",
    "comp": "$.salary",
    "description": "$.body",
}


def observed_jobs(spark, sf) -> DataFrame:
    """Sightings with the job's role and location, for market questions."""
    obs = spread(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"))
    jobs = obs.join(job_parts(spark, sf), F.col("l_partkey") == F.col("p_partkey"))
    return with_place(jobs, spark, sf, "l_suppkey").select(
        _id("l_partkey", "l_suppkey").alias("posting_id"), "role", "location", "region",
        "skills", F.col("l_shipdate").alias("seen_at"), F.col("l_extendedprice").alias("comp"),
    )


def profile_terms(spark, sf) -> DataFrame:
    """How often each word occurs in a profile: words of the parts it ordered."""
    return (
        table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
        .join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"),
              F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "part").select("p_partkey", "p_name"),
              F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("o_custkey").alias("profile_id"), F.explode(F.split("p_name", " ")).alias("skill"))
        .groupBy("profile_id", "skill").agg(F.count(F.lit(1)).alias("mentions"))
    )


def profile_skills(spark, sf, at_least: int = 3) -> DataFrame:
    return profile_terms(spark, sf).where(F.col("mentions") >= at_least)


def target_roles(spark, sf) -> DataFrame:
    """The role each profile looks for: the one it ordered most."""
    counts = (
        table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
        .join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"),
              F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "part").select("p_partkey", "p_type"),
              F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("o_custkey").alias("profile_id"), F.col("p_type").alias("role"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy("profile_id").agg(F.max_by("role", F.struct("n", "role")).alias("role"))


def vector_profiles(spark, sf) -> DataFrame:
    """Every vector as a profile: home location, pay floor and skills of its customer."""
    skills = profile_skills(spark, sf).groupBy("profile_id").agg(
        F.array_sort(F.collect_set("skill")).alias("profile_skills")
    )
    customer = table(spark, sf, "customer")
    return (
        table(spark, sf, "embeddings")
        .join(customer, F.col("vec_id") == F.col("c_custkey"), "left")
        .join(skills, F.col("vec_id") == F.col("profile_id"), "left")
        .select(
            F.col("vec_id").alias("profile_id"), "embedding",
            F.col("label").alias("home"),
            (F.lit(900.0) + F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 100.0).alias("comp_floor"),
            F.coalesce("profile_skills", F.array().cast("array<string>")).alias("profile_skills"),
        )
    )


def vector_jobs(spark, sf) -> DataFrame:
    """Every vector as a posting: attributes of its part."""
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_name")
    return (
        table(spark, sf, "embeddings")
        .join(part, F.col("vec_id") == F.col("p_partkey"), "left")
        .select(
            F.col("vec_id").alias("job_id"), "embedding",
            F.col("label").alias("place"),
            F.col("p_retailprice").alias("comp"),
            F.coalesce(F.split("p_name", " "), F.array().cast("array<string>")).alias("job_skills"),
        )
    )


def applications(spark, sf) -> DataFrame:
    return as_applications(table(spark, sf, "events"))


def as_applications(events: DataFrame) -> DataFrame:
    """Status events of applications: one application per (user, slot)."""
    slot = F.get_json_object("props", "$.k").cast("bigint")
    status = F.lit(None).cast("string")
    for event, name in STATUS_OF_EVENT.items():
        status = F.when(F.col("event_type") == event, name).otherwise(status)
    return events.select(
        F.col("user_id").alias("profile_id"),
        F.pmod(slot, F.lit(10)).alias("job_id"),
        status.alias("status"),
        F.col("ts").alias("at"),
        "event_id",
    )


def ops_events(spark, sf) -> DataFrame:
    """The events table read as an operations log."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf, "events").select(
        "event_id", "ts",
        F.col("event_type").alias("source"),
        F.col("value").alias("latency"),
        (k < 70).alias("hit"),
        F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", -1)
        .otherwise(0).cast("bigint").alias("delta"),
    )


def documents(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "documents").select(
        F.col("doc_id").alias("posting_id"), F.col("text").alias("description"), "source"))


def dictionary(spark, sf) -> DataFrame:
    """Skill dictionary with aliases: the words, pairs and triples of words of the benchmark texts."""
    return (
        table(spark, sf, "benchmark").select(tokens("text").alias("words"))
        .select(F.explode(ngrams(F.col("words"), 3)).alias("alias"))
        .distinct()
        .select(F.replace("alias", F.lit(" "), F.lit("-")).alias("skill"), "alias")
    )
