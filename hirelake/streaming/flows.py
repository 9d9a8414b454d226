"""Structured Streaming forms of ingestion, freshness, feeds, reminders and metrics.

Event time is a ``timestamp`` column: watermarks do not accept ``timestamp_ntz``.
Rows later than the stated lateness may be dropped by the stateful operators; the
batch operators over the stored history remain the full answer. On timely rows no answer
depends on how they were cut into micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from hirelake.operators.copilot import CLOSED, KEYS
from hirelake.operators.match import Rules, top_matches
from hirelake.session import ROCKSDB, fresh_dir, materialize


def event_time(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp"))


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None,
                name_glob: str | None = None) -> DataFrame:
    reader = spark.readStream.format("parquet").schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return reader.load(path)


def _trigger(writer, trigger: str | None):
    """``None`` drains what is there and stops (on demand); else a processing-time interval."""
    return writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append",
             trigger: str | None = None, partition_by: tuple[str, ...] = ()) -> StreamingQuery:
    writer = df.writeStream.format("parquet").outputMode(mode).option("path", path).partitionBy(*partition_by)
    return _trigger(writer.option("checkpointLocation", checkpoint), trigger).start()


def to_batches(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
               trigger: str | None = None) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    return _trigger(writer, trigger).start()


def to_raw(df: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Append postings to a raw store, partitioned by fetch date as ``stores.write_raw`` does, each exactly
    once. Rows of a source without ``fetched_at`` have no date to go by and are not partitioned. A
    folder that a stream writes lists its own files, so leave it to streams."""
    if "fetched_at" not in df.columns:
        return to_table(df, path, checkpoint, trigger=trigger)
    dated = df.withColumn("fetch_date", F.to_date("fetched_at"))
    return to_table(dated, path, checkpoint, trigger=trigger, partition_by=("fetch_date",))


def ingest_stream(spark: SparkSession, source: str, path: str, checkpoint: str, trigger: str | None = None,
                  options: dict | None = None) -> StreamingQuery:
    """Pull what is new at a registered source into a raw store, scheduled or on demand."""
    return to_raw(spark.readStream.format(source).options(**(options or {})).load(), path, checkpoint, trigger)


def ingest_files(spark: SparkSession, landed: str, schema: StructType, path: str, checkpoint: str,
                 trigger: str | None = None) -> StreamingQuery:
    """Pull landed files that were not pulled before into a raw store, each exactly once and in
    whatever order of names they arrive. Files may lie in folders by day."""
    return to_raw(file_stream(spark, landed, schema), path, checkpoint, trigger)


def replay(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1,
           name_glob: str | None = None) -> DataFrame:
    """Stored history as a stream, oldest files first."""
    return file_stream(spark, path, schema, files_per_trigger, name_glob)


def dedupe_stream(df: DataFrame, keys: list[str], at: str, horizon: str) -> DataFrame:
    """Drop rows whose keys were seen within the horizon."""
    return event_time(df, at).withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys)


def seen_stream(df: DataFrame, key: str = "posting_id", at: str = "seen_at") -> DataFrame:
    """First and last sighting kept as state; run in update mode."""
    return df.groupBy(key).agg(
        F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("n_seen"))


def latest_versions(updates: DataFrame, key: str = "posting_id", version: str = "n_seen") -> DataFrame:
    """The newest row per key of an update-mode log."""
    rest = [c for c in updates.columns if c != key]
    newest = F.max_by(F.struct(*rest), version).alias("_r")
    return updates.groupBy(key).agg(newest).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


#: One key of a group of keys in state.
HELD = pa.schema([("key", pa.string()), ("opened", pa.int64()), ("first_us", pa.int64()), ("last_us", pa.int64()),
                  ("n_seen", pa.int64())])


class _Sightings(StatefulProcessor):
    """Sightings of each key of a group since it came up; a key is forgotten when it has not been seen for a while.

    The keys of a group are one Arrow batch of state and one timer, so the calls and the
    transport between the engine and Python are paid for a group and not for a key.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spells = handle.getValueState("spells", "due bigint, held binary")

    def _known(self) -> tuple[int | None, pa.Table]:
        state = self.spells.get()
        if state is None:
            return None, HELD.empty_table()
        return state[0], pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(bytes(state[1])), HELD)])

    def _keep(self, held: pa.Table, due: int | None) -> None:
        """Keep the keys held and a timer for the first of them to end; one that is set earlier may stay."""
        first = pc.min(held["last_us"]).as_py() // 1000 + self.idle_ms
        if due is None or first < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(first)
            due = first
        self.spells.update((due, held.combine_chunks().to_batches()[0].serialize().to_pybytes()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due, known = self._known()
        parts = [known.append_column("touched", pa.array(np.zeros(len(known), np.int8)))]
        for frame in rows:
            at, many = pa.array(frame["at_us"].to_numpy(np.int64)), len(frame)
            parts.append(pa.Table.from_arrays(
                [pa.array(frame["key"].tolist(), pa.string()), pa.nulls(many, pa.int64()), at, at,
                 pa.array(np.ones(many, np.int64)), pa.array(np.ones(many, np.int8))], names=parts[0].column_names))
        now = pa.concat_tables(parts).group_by("key", use_threads=False).aggregate(
            [("opened", "max"), ("first_us", "min"), ("last_us", "max"), ("n_seen", "sum"), ("touched", "max")])
        held = pa.Table.from_arrays(
            [now["key"], pc.coalesce(now["opened_max"], now["first_us_min"]), now["first_us_min"], now["last_us_max"],
             now["n_seen_sum"]], schema=HELD)
        self._keep(held, due)
        yield held.filter(pc.equal(now["touched_max"], 1)).to_pandas().assign(ended=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, known = self._known()
        if due is None:
            return
        past = known["last_us"].to_numpy() // 1000 + self.idle_ms <= timerValues.getCurrentWatermarkInMs()
        if past.all():
            self.spells.clear()
        else:
            self._keep(known.filter(pa.array(~past)), None)
        if past.any():
            yield known.filter(pa.array(past)).to_pandas().assign(ended=True)

    def close(self) -> None:
        pass


def seen_spells(df: DataFrame, idle_days: float, lateness: str, key: str = "posting_id",
                at: str = "seen_at", groups: int = 65_536) -> DataFrame:
    """First and last sighting as state that ends: a key not seen for ``idle_days`` is given out as
    ``ended`` and forgotten, and opens a new spell if it comes back. So the state holds the
    keys in sight, not all that ever were. Run in update mode; every batch gives the spells
    it touched so far. Sightings without a time are left out.

    Keys, of a type that text can hold, are dealt by hash to ``groups``, which are read and
    written whole: choose them so that a group has some hundred keys in sight. A stream that
    has begun must keep their number."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = (
        event_time(df.where(F.col(at).isNotNull()), at).withWatermark(at, lateness)
        .select(F.pmod(F.xxhash64(F.col(key)), F.lit(groups)).cast("int").alias("_group"),
                F.col(key).cast("string").alias("key"), at, F.unix_micros(at).alias("at_us"))
    )
    spells = timed.groupBy("_group").transformWithStateInPandas(
        statefulProcessor=_Sightings(int(idle_days * 86_400_000)),
        outputStructType="key string, opened bigint, first_us bigint, last_us bigint, n_seen bigint, ended boolean",
        outputMode="update", timeMode="EventTime",
    )
    wall = lambda c: F.timestamp_micros(c).cast(df.schema[at].dataType)
    return spells.select(F.col("key").cast(df.schema[key].dataType).alias(key), "opened", wall("first_us").alias("first_seen"),
                         wall("last_us").alias("last_seen"), "n_seen", "ended")


def seen_of_spells(spells: DataFrame, key: str = "posting_id") -> DataFrame:
    """The snapshot from a log of spells: the newest row of each spell, spells of a key merged. How
    often a key ended depends on the batches; the snapshot does not."""
    newest = spells.groupBy(key, "opened").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
                                               F.max("n_seen").alias("n_seen"))
    return newest.groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
                                   F.sum("n_seen").alias("n_seen"))


def throughput_stream(events: DataFrame, width: str, lateness: str) -> DataFrame:
    """Events per window and source: closed windows in append mode, and in update mode also
    the counts so far of open ones."""
    return (
        event_time(events, "ts").withWatermark("ts", lateness)
        .groupBy(F.window("ts", width).alias("w"), "source").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "source", "n")
    )


def match_feed(jobs: DataFrame, profiles: DataFrame, k: int, min_score: float, path: str, checkpoint: str,
               rules: Rules = Rules(), trigger: str | None = None) -> StreamingQuery:
    """The ``k`` best jobs so far of each profile that score ``min_score`` or more, as changes.

    Two streams: one matches the jobs of a batch and lands the best of each profile, the other
    keeps the best so far of a profile as state and writes only what comes into it and what leaves
    it. A batch that is repeated after a failure lands its rows again, which changes nothing, as a
    job counts once with its best score. So what ``read_feed`` gives does not depend on the
    batches, and what a batch writes grows with the changes, not with the profiles. The query
    returned is the second; without a trigger the first has ended, else it runs beside it.
    """
    spark, wish = jobs.sparkSession, Rules(rules.equal, rules.at_least, rules.exclude_self, min_score)
    people, landed = materialize(profiles, "people"), f"{path}/found"
    kinds = dict(profiles.dtypes)["profile_id"], dict(jobs.dtypes)["job_id"]
    schema = StructType.fromDDL(f"profile_id {kinds[0]}, job_id {kinds[1]}, score double")
    spark.createDataFrame([], schema).write.mode("append").parquet(landed)

    def sink(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            top_matches(people, batch, k, wish).select(*schema.names).write.mode("append").parquet(landed)

    found = to_batches(jobs, sink, f"{checkpoint}/found", trigger=trigger)
    if trigger is None:
        found.awaitTermination()
    return to_table(best_so_far(file_stream(spark, landed, schema), k), f"{path}/changes", f"{checkpoint}/changes",
                    trigger=trigger)


class _Best(StatefulProcessor):
    """The best jobs of one profile so far; gives out the ones that come in and that leave."""

    def __init__(self, k: int, job_kind: str):
        self.k, self.job_kind = k, job_kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", f"version bigint, jobs array<{self.job_kind}>, scores array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.best.get()
        version, before = (known[0], dict(zip(known[1], known[2]))) if known else (0, {})
        seen = dict(before)
        for r in rows:
            seen[r.job_id] = max(r.score, seen.get(r.job_id, r.score))
        after = dict(sorted(seen.items(), key=lambda s: (-s[1], s[0]))[:self.k])
        gone = [(job, score, False) for job, score in before.items() if job not in after]
        come = [(job, score, True) for job, score in after.items() if before.get(job) != score]
        if gone or come:
            self.best.update((version + 1, list(after), list(after.values())))
        for job, score, entered in gone + come:
            yield Row(profile_id=key[0], job_id=job, score=score, entered=entered, version=version + 1)

    def close(self) -> None:
        pass


def best_so_far(found: DataFrame, k: int) -> DataFrame:
    """Changes of the ``k`` best ``job_id, score`` of each profile: a row ``entered`` for a job that comes
    in or gets a better score, and one that is not for a job that leaves. The state of a profile
    holds ``k`` jobs."""
    found.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kinds = dict(found.dtypes)
    return found.groupBy("profile_id").transformWithState(
        statefulProcessor=_Best(k, kinds["job_id"]),
        outputStructType=f"profile_id {kinds['profile_id']}, job_id {kinds['job_id']}, score double, entered boolean, version bigint",
        outputMode="append", timeMode="None",
    )


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """``profile_id, job_id, score, rank``: the feed as the changes so far leave it."""
    changes = spark.read.parquet(f"{path}/changes")
    last = changes.groupBy("profile_id", "job_id").agg(F.max_by(F.struct("entered", "score"), "version").alias("m"))
    order = Window.partitionBy("profile_id").orderBy(F.desc("score"), "job_id")
    return last.where("m.entered").select("profile_id", "job_id", "m.score").withColumn("rank", F.row_number().over(order))


class _Reminder(StatefulProcessor):
    """Latest status per application and whether its reminder was sent. A rest that ends
    inside a batch is judged between the events; one that is still open, by a timer."""

    def __init__(self, after_ms: int):
        self.after_ms = after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_us bigint, event_id bigint, status string, sent boolean")

    def _reminder(self, key, at_us: int, status: str) -> pd.DataFrame:
        return pd.DataFrame({"profile_id": [key[0]], "job_id": [key[1]], "status": [status], "since_us": [at_us]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = [(int(r.at_us), int(r.event_id), str(r.status)) for frame in rows
                  for r in frame[["at_us", "event_id", "status"]].itertuples(index=False)]
        known = tuple(self.last.get()) if self.last.exists() else None
        sent = known is not None and known[3]
        if known is not None:
            events.append(known[:3])
        events.sort()
        sent_at = known[:3] if sent else None
        for event, after in zip(events, events[1:]):
            rested = after[0] // 1000 - event[0] // 1000 >= self.after_ms
            if rested and event[2] not in CLOSED and event != sent_at:
                yield self._reminder(key, event[0], event[2])
        last = events[-1]
        self.last.update((*last, last == sent_at))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if last[2] not in CLOSED and last != sent_at:
            self.handle.registerTimer(last[0] // 1000 + self.after_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            at_us, event_id, status, sent = self.last.get()
            if not sent:
                self.last.update((at_us, event_id, status, True))
                yield self._reminder(key, at_us, status)

    def close(self) -> None:
        pass


def reminder_stream(events: DataFrame, after_days: float, lateness: str) -> DataFrame:
    """Emit an application whenever it has been open and unchanged for ``after_days``."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = (
        event_time(events, "at").withWatermark("at", lateness)
        .withColumn("at_us", F.unix_micros("at"))
    )
    return timed.groupBy(*KEYS).transformWithStateInPandas(
        statefulProcessor=_Reminder(int(after_days * 86_400_000)),
        outputStructType="profile_id bigint, job_id bigint, status string, since_us bigint",
        outputMode="append", timeMode="EventTime",
    ).withColumn("since", F.timestamp_micros("since_us")).drop("since_us")


def drain(df: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available and give its output as a table."""
    spark = df.sparkSession
    out, checkpoint = fresh_dir(spark, label), fresh_dir(spark, f"{label}-checkpoint")
    if mode == "append":
        query = to_table(df, out, checkpoint)
    else:
        def sink(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

        query = to_batches(df, sink, checkpoint, mode)
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out).select(*df.columns)
