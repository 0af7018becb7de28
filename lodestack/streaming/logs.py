"""Append-only logs, in batch or as streams: the same functions take both kinds of DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.aggregates import latest

# States of a job and which of them are final.
STATES = ("queued", "running", "ready", "failed", "cancelled")
FINAL = ("ready", "failed", "cancelled")


def event_windows(events: DataFrame, width: str, late: str = "2 hours") -> DataFrame:
    """Counts and sums per user and tumbling window; on a stream, what is later than ``late`` is dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    got = rows.groupBy("user_id", F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return got.select("user_id", F.col("window.start").alias("window_start"), "n", "total")


def job_states(log: DataFrame) -> DataFrame:
    """Latest state of each job and how long it has been known: log is (job, state, ts, seq)."""
    return log.groupBy("job").agg(F.max_by("state", F.struct("ts", "seq")).alias("state"), F.min("ts").alias("submitted"), F.max("ts").alias("changed"))


def recovered(states: DataFrame) -> DataFrame:
    """After a crash: what was running has failed."""
    return states.withColumn("state", F.when(F.col("state") == "running", "failed").otherwise(F.col("state")))


def submitted_once(requests: DataFrame, key: str, active: DataFrame) -> DataFrame:
    """Requests, one a key, whose key is not that of a job that has not ended."""
    waiting = active.where(~F.col("state").isin(*FINAL)).select(F.col("job").alias(key))
    return requests.dropDuplicates([key]).join(waiting, key, "left_anti")


def unscored_blocks(pairs: DataFrame, scores: DataFrame, size: int) -> DataFrame:
    """(block, pairs, left_over) of the blocks of ``size`` keys in which some pair has no score yet; both tables: (key)."""
    scored = scores.select("key").distinct().withColumn("_done", F.lit(True))
    met = pairs.withColumn("block", F.floor(F.col("key") / size).cast("long")).join(scored, "key", "left")
    return met.groupBy("block").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("_done").isNull()).alias("left_over")).where("left_over > 0")


#: Runs that are merged into one of the next level.
FAN = 4


def follow_latest(records: DataFrame, keys: tuple[str, ...], at: str, pos: str, folder: str, checkpoint: str, fan: int = FAN) -> StreamingQuery:
    """Keep the latest record of each key next to a stream of records, in a log-structured folder.

    Each micro-batch is reduced and written as a sorted run of level 0; whenever ``fan`` batches (``fan`` squared, and so on) are
    complete, their runs are merged into one of the next level. So a batch writes its own records, and every record is written again once
    a level: the logarithm of the number of batches. Runs are named by level and the batches that they cover and count once they are
    complete, so a batch that is run again after a failure writes the same or finds it done. Read with ``read_latest``.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not _exists(spark, f"{folder}/about/_SUCCESS"):
            spark.createDataFrame([(list(keys), at, pos)], "keys array<string>, at string, pos string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/about")
        if not any(level and first <= number <= last for level, first, last in runs(spark, folder)):
            _write_run(latest(batch, keys, at, pos).select(*batch.columns), keys, folder, (0, number, number))
        level, width = 1, fan
        while (number + 1) % width == 0:
            merged, every = (level, number + 1 - width, number), runs(spark, folder)
            covered = [r for r in every if r[0] < level and merged[1] <= r[1] and r[2] <= number]
            if covered and not any(r[0] >= level and r[1] <= merged[1] and number <= r[2] for r in every):
                rows = spark.read.parquet(*(_path(folder, r) for r in _newest(covered)))
                _write_run(latest(rows, keys, at, pos).select(*batch.columns), keys, folder, merged)
            for r in covered:
                fs, path = _filesystem(spark, _path(folder, r))
                fs.delete(path, True)
            level, width = level + 1, width * fan

    return records.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()


def _write_run(rows: DataFrame, keys: tuple[str, ...], folder: str, run: tuple[int, int, int]) -> None:
    rows.sortWithinPartitions(*keys).write.mode("overwrite").parquet(_path(folder, run))


def _path(folder: str, run: tuple[int, int, int]) -> str:
    return f"{folder}/runs/{run[0]:02d}-{run[1]:012d}-{run[2]:012d}"


def _filesystem(spark, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _exists(spark, path: str) -> bool:
    fs, place = _filesystem(spark, path)
    return fs.exists(place)


def runs(spark, folder: str) -> list[tuple[int, int, int]]:
    """(level, first batch, last batch) of the runs that were written whole."""
    fs, root = _filesystem(spark, f"{folder}/runs")
    names = [f.getPath().getName() for f in (fs.listStatus(root) if fs.exists(root) else [])]
    return [tuple(map(int, n.split("-"))) for n in names if _exists(spark, f"{folder}/runs/{n}/_SUCCESS")]


def _newest(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs without those that a run of a higher level covers (left behind by a merge that was cut short)."""
    return sorted(r for r in found if not any(o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in found))


def read_latest(spark, folder: str) -> DataFrame | None:
    """The latest record of every key over all runs, or None."""
    found = _newest(runs(spark, folder))
    if not found:
        return None
    keys, at, pos = spark.read.parquet(f"{folder}/about").first()
    rows = spark.read.parquet(*(_path(folder, r) for r in found))
    return latest(rows, tuple(keys), at, pos).select(*rows.columns)


def job_machine(events: DataFrame, lease: int, late: int = 60) -> DataFrame:
    """A stream of job events (job, state, ts, seq) through a checked state machine: (job, seq, ts, state, verdict).

    An event is taken if its state may follow the job's; else it is refused and the state stays. ``running`` may follow itself, which
    renews its lease of ``lease`` seconds. A job whose lease has run out has failed at that moment (verdict lost, no seq), told when
    its next event comes or when the watermark, ``late`` seconds behind the newest event, passes it. A job that has not ended refuses
    to be queued again, so one key has one job under way. The state is one small row a job, in the stream's checkpoint.
    """
    follows = {None: {"queued"}, "queued": {"running", "failed", "cancelled"}, "running": {"running", *FINAL}, **{s: {"queued"} for s in FINAL}}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, until = state.get if state.exists else (None, 0)
        out: list[tuple] = []

        def expire(moment: int) -> None:
            nonlocal now
            if now == "running" and until < moment:
                out.append((key[0], None, until, "failed", "lost"))
                now = "failed"

        if state.hasTimedOut:
            expire(until + 1)
        else:
            rows = pd.concat(list(batches))
            for seq, ts, wanted in sorted(zip(rows["seq"], rows["micros"], rows["state"]), key=lambda r: (r[1], r[0])):
                expire(ts)
                taken = wanted in follows.get(now, ())
                if taken:
                    now, until = wanted, ts + lease * 1_000_000
                out.append((key[0], seq, ts, now, "taken" if taken else "refused"))
        if now is not None:
            state.update((now, until))
        if now == "running" and (due := until // 1000 + 1) > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(due)
        elif now == "running":  # the watermark has passed the lease already
            expire(until + 1)
            state.update((now, until))
        made = pd.DataFrame(out, columns=["job", "seq", "micros", "state", "verdict"])
        yield made.astype({"seq": "Int64", "micros": "int64"})

    kind = events.schema["job"].dataType.simpleString()
    rows = events.withWatermark("ts", f"{late} seconds").withColumn("micros", F.unix_micros("ts"))
    told = rows.groupBy("job").applyInPandasWithState(step, f"job {kind}, seq bigint, micros bigint, state string, verdict string", "state string, until bigint", "append", GroupStateTimeout.EventTimeTimeout)
    return told.select("job", "seq", F.timestamp_micros("micros").alias("ts"), "state", "verdict")
