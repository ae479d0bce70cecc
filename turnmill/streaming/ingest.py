"""Incremental processing: each id is handled once, failures are tried again.

What became of an id is state of the stream, kept by key in the state store: a batch looks up its own
ids and reads nothing of earlier batches. Every batch writes its results and then its status rows
into folders of its own batch id; the status rows flow back into the stream as its second input. A
batch that is repeated after a failure replaces what it wrote, so nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnmill.operators.diarization import (
    FAILED,
    IGNORED,
    MAX_MINUTES,
    PROCESSED,
    duration_guard,
    pending_videos,
)
from turnmill.sources.versions import make_folder, publish, read_version

STATUS_ROWS = "id string, status string, batch_id bigint"


def read_written(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows that all batches wrote; none when nothing ran yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        # Only a table that is not there means that nothing ran: any other fault must not redo all.
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """Status rows of all batches."""
    return read_written(spark, path, STATUS_ROWS)


def handle_batch(
    pending: DataFrame,
    batch_id: int,
    out: str,
    process: Callable[[DataFrame], DataFrame],
    limit: float = MAX_MINUTES,
) -> None:
    """Handle pending ids, one row each: id, url, minutes.

    ``process`` maps them to results with id and error. Too long videos are ignored for good. A
    batch without ids writes nothing.
    """
    spark = pending.sparkSession
    # Written once: results and ignored rows both come from it.
    guarded = f"{out}/guarded/batch_id={batch_id}"
    duration_guard(pending, limit).write.mode("overwrite").parquet(guarded)
    fresh = spark.read.parquet(guarded)
    if fresh.isEmpty():
        return
    results = process(fresh.filter("not too_long").drop("too_long"))
    results.write.mode("overwrite").parquet(f"{out}/results/batch_id={batch_id}")
    written = spark.read.schema(results.schema).parquet(f"{out}/results/batch_id={batch_id}")
    done = written.select(
        "id", F.when(F.col("error").isNull(), PROCESSED).otherwise(FAILED).alias("status")
    ).distinct()
    ignored = fresh.filter("too_long").select("id", F.lit(IGNORED).alias("status"))
    done.unionByName(ignored).write.mode("overwrite").parquet(f"{out}/status/batch_id={batch_id}")


def process_batch(
    batch: DataFrame,
    batch_id: int,
    out: str,
    process: Callable[[DataFrame], DataFrame],
    limit: float = MAX_MINUTES,
) -> None:
    """handle_batch for the ids of a table that have no final status in any other batch."""
    before = read_status(batch.sparkSession, f"{out}/status").filter(F.col("batch_id") != batch_id)
    once = batch.groupBy("id").agg(
        F.max_by("url", F.coalesce("minutes", F.lit(-1.0))).alias("url"), F.max("minutes").alias("minutes")
    )
    handle_batch(pending_videos(once, before), batch_id, out, process, limit)


#: What the stream keeps of an id whose state expires: where it stands, failed tries, the batch of the last one counted,
#: and whether it came again while its result was not known yet.
STATE = "status string, tries int, counted bigint, again boolean, url string, minutes double"
PENDING = "id string, url string, minutes double"
ASKED = "asked"


def pending_ids(
    arrivals: DataFrame, status: DataFrame, max_tries: int = 1, expire_ms: int | None = None
) -> DataFrame:
    """A stream of ids to process: PENDING rows, each id once until its status is known.

    arrivals: a stream of id, url, minutes. status: the stream of STATUS_ROWS that the batches
    wrote. A processed or ignored id is done. A failed one is open again: it is given out when it
    arrives once more, or by itself while it failed less than ``max_tries`` times. State that
    nothing touched for ``expire_ms`` is dropped, and the id is new if it comes again. Without
    ``expire_ms`` the stream is written in update mode.

    The state of an id is the distinct entries of each batch that touched it, kept by an aggregate, so it
    grows by one or a few with each such batch. Only state that expires passes through Python, by the id.
    """
    columns = {"id": "string", "url": "string", "minutes": "double", "status": "string", "batch_id": "bigint"}
    shaped = lambda df: df.select(
        *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]
    )
    events = shaped(arrivals).unionByName(shaped(status))
    if expire_ms:
        return _expiring_ids(events, max_tries, expire_ms)
    # The time of a batch is the same in all its rows, and when it is repeated. All is in one set,
    # because its form in the state does not follow what is NULL in a batch.
    came = F.col("status").isNull().alias("came")
    entry = F.struct("at", came, "batch_id", "status", "minutes", "url")
    kept = events.withColumn("at", F.current_timestamp()).groupBy("id").agg(F.collect_set(entry).alias("told"))

    def arrival(e: Column) -> Column:
        minutes = F.nanvl(F.coalesce(e["minutes"], F.lit(-1.0)), F.lit(-1.0))
        return F.struct(e["at"].alias("at"), minutes.alias("minutes"), F.coalesce(e["url"], F.lit("")), e["url"].alias("url"))

    latest = F.array_max(F.transform(F.filter("told", lambda e: e["came"]), arrival))
    asked = kept.filter(_asks(F.array_sort("told"), max_tries)).withColumn("latest", latest)
    return asked.select(
        "id", F.col("latest.url").alias("url"), F.when(F.col("latest.minutes") >= 0, F.col("latest.minutes")).alias("minutes")
    )


def _asks(told: Column, max_tries: int) -> Column:
    """Whether an id is given out in the last batch of its history: entries in order of at (the batch),
    came, batch_id, status."""
    done = lambda c: F.coalesce(c.isin(PROCESSED, IGNORED), F.lit(False))
    start = F.struct(
        F.lit(None).cast("string").alias("stands"), F.lit(0).alias("tries"), F.lit(None).cast("bigint").alias("counted"),
        F.lit(False).alias("again"), F.lit(False).alias("came"), F.lit(0).cast("timestamp").alias("at"),
    )

    def take(now: Column, e: Column) -> Column:
        """One entry; came is whether the id arrived in its batch so far."""
        failed = ~e["came"] & ~done(e["status"]) & ~done(now["stands"])
        return F.struct(
            F.when(~e["came"] & done(e["status"]), e["status"]).when(failed, FAILED).otherwise(now["stands"]).alias("stands"),
            (now["tries"] + (failed & ~e["batch_id"].eqNullSafe(now["counted"])).cast("int")).alias("tries"),
            F.when(failed, e["batch_id"]).otherwise(now["counted"]).alias("counted"),
            now["again"].alias("again"),
            (now["came"] | e["came"]).alias("came"),
            e["at"].alias("at"),
        )

    def wanted(now: Column) -> Column:
        return now["came"] | now["again"] | (now["stands"].eqNullSafe(F.lit(FAILED)) & (now["tries"] < max_tries))

    def asked(now: Column) -> Column:
        return wanted(now) & (now["stands"].isNull() | (now["stands"] == FAILED))

    def settled(now: Column) -> Column:
        """After the end of a batch."""
        again = now["stands"].eqNullSafe(F.lit(ASKED)) & wanted(now)
        return F.struct(
            F.when(asked(now), ASKED).otherwise(now["stands"]).alias("stands"), now["tries"].alias("tries"),
            now["counted"].alias("counted"), again.alias("again"), F.lit(False).alias("came"), now["at"].alias("at"),
        )

    def step(acc: Column, e: Column) -> Column:
        before = F.when(acc["at"] == e["at"], acc).otherwise(settled(acc))
        # In a transform of one element it has a name, and is computed once.
        return F.transform(F.array(before), lambda now: take(now, e))[0]

    return F.aggregate(told, start, step, asked)


def _expiring_ids(events: DataFrame, max_tries: int, expire_ms: int) -> DataFrame:
    """pending_ids with a time to live for the state of an id."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stands, tries, counted, again, url, minutes = state.get if state.exists else (None, 0, None, False, None, None)
        told, came = [], []
        for part in parts:
            for row in part.itertuples():
                if row.status is not None:
                    told.append((int(row.batch_id), row.status))
                else:
                    came.append((-1.0 if pd.isna(row.minutes) else row.minutes, row.url or "", row.url))
        for batch, said in sorted(told):
            if said in (PROCESSED, IGNORED):
                stands = said
            elif stands not in (PROCESSED, IGNORED):
                stands, tries = FAILED, tries + (batch != counted)
                counted = batch
        if came:
            most = max(came)
            url, minutes = most[2], None if most[0] < 0 else most[0]
        wanted = bool(came) or again or (stands == FAILED and tries < max_tries)
        ask = wanted and stands in (None, FAILED)
        again = stands == ASKED and wanted
        state.update((ASKED if ask else stands, tries, counted, again, url, minutes))
        state.setTimeoutDuration(expire_ms)
        if ask:
            yield pd.DataFrame({"id": [key[0]], "url": [url], "minutes": [minutes]})

    return events.groupBy("id").applyInPandasWithState(
        step, PENDING, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB with a changelog: what a batch writes grows with its own keys."""
    settings = {
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def ingest_incremental(
    manifest_stream: DataFrame,
    out: str,
    process: Callable[[DataFrame], DataFrame],
    limit: float = MAX_MINUTES,
    max_tries: int = 1,
    expire_ms: int | None = None,
) -> list[dict]:
    """Process everything that has arrived, then stop. Run again to take up where it ended.

    A run knows the status rows that were there when it started, so an id that failed in a run is
    open again in the next one. Returns the progress of the last batches, as Spark reports it.
    """
    spark = manifest_stream.sparkSession
    make_folder(spark, f"{out}/status")
    status = spark.readStream.schema(STATUS_ROWS).parquet(f"{out}/status")
    pending = pending_ids(manifest_stream, status, max_tries, expire_ms)
    with rocksdb(spark):
        query = (
            pending.writeStream.outputMode("append" if expire_ms else "update")
            .trigger(availableNow=True)
            .option("checkpointLocation", f"{out}/checkpoint")
            .foreachBatch(lambda df, n: handle_batch(df, n, out, process, limit))
            .start()
        )
        query.awaitTermination()
    return query.recentProgress


def retry_failed(
    spark: SparkSession,
    manifest: DataFrame,
    out: str,
    process: Callable[[DataFrame], DataFrame],
    limit: float = MAX_MINUTES,
) -> None:
    """One more batch for the ids of the manifest whose last try failed."""
    status = read_status(spark, f"{out}/status")
    lowest = status.agg(F.min("batch_id").alias("n")).first().n
    if lowest is None:
        return
    failed = status.filter(F.col("status") == FAILED).select("id").distinct()
    again = manifest.join(failed, "id", "left_semi")
    # Retries take negative numbers, which the stream never uses.
    process_batch(again, min(lowest, 0) - 1, out, process, limit)


def final_status(spark: SparkSession, out: str) -> DataFrame:
    """One row per id: processed and ignore win over an earlier failure."""
    names = [FAILED, IGNORED, PROCESSED]
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("status"))
    ranks = read_status(spark, f"{out}/status").groupBy("id").agg(F.max(rank).alias("rank"))
    return ranks.select("id", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("rank").cast("int")).alias("status"))


def running_counts(
    stream: DataFrame, key: str, out: str, name: str = "running_counts"
) -> None:
    """Keep rows per key up to date while rows arrive.

    A batch gives the new counts of the keys that it touched. They replace those of the version
    before in a new version, which is published when it is whole: see read_counts.
    """
    path = f"{out}/{name}"
    counted = stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"))

    def save(changed: DataFrame, batch_id: int) -> None:
        before = read_version(changed.sparkSession, path, counted.schema, below=batch_id)
        same = changed[key].eqNullSafe(before[key])
        publish(before.join(changed, same, "left_anti").unionByName(changed), path, batch_id)

    with rocksdb(stream.sparkSession):
        query = (
            counted.writeStream.outputMode("update")
            .trigger(availableNow=True)
            .option("checkpointLocation", f"{path}/checkpoint")
            .foreachBatch(save)
            .start()
        )
        query.awaitTermination()


def read_counts(
    spark: SparkSession, out: str, schema: str | T.StructType, name: str = "running_counts"
) -> DataFrame:
    """The counts as of the last published batch; no rows before the first."""
    return read_version(spark, f"{out}/{name}", schema)
