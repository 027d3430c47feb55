"""Intakes as state machines: a folder's files, jobs with leases, deliveries, a mailbox, an event log.

Each rule is a function over columns or over the rows of one key, used by the batch
form and, through `applyInPandasWithState` and `foreachBatch`, by the streaming form.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.session import cut_lineage

#: Seconds before each further try of a delivery.
RETRY_SECONDS = (5, 300, 1800, 7200, 18000, 36000, 36000)
#: Endings of files that are still being written.
PARTIAL = (".part", ".tmp", ".crdownload", ".download", ".partial")


def claimable(name):
    """Whether a file of the inbox may be taken at all."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    unfinished = F.lit(False)
    for ending in PARTIAL:
        unfinished = unfinished | F.endswith(F.lower(base), F.lit(ending))
    return ~F.startswith(base, F.lit(".")) & ~unfinished & (base != "")


def settled(scans: DataFrame) -> DataFrame:
    """Batch form: the first scan (`scan_no`) at which a path has the size and time of the scan before."""
    w = Window.partitionBy("path").orderBy("scan_no")
    same = (F.col("size") == F.lag("size").over(w)) & (F.col("mtime") == F.lag("mtime").over(w))
    return scans.where(claimable(F.col("path"))).withColumn("_same", same).where("_same").groupBy("path").agg(F.min("scan_no").alias("claimed_at"))


def settled_stream(scans: DataFrame) -> DataFrame:
    """Streaming form: state per path holds the last stamp; a path comes out once, when two scans agree."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, mtime, done = state.get if state.exists else (-1, -1, False)
        out = []
        rows = pd.concat(list(batches)).sort_values("scan_no")
        for r in rows.itertuples(index=False):
            if not done and r.size == size and r.mtime == mtime:
                out.append((key[0], int(r.scan_no)))
                done = True
            size, mtime = int(r.size), int(r.mtime)
        state.update((size, mtime, done))
        yield pd.DataFrame(out, columns=["path", "claimed_at"])

    return scans.where(claimable(F.col("path"))).groupBy("path").applyInPandasWithState(step, "path string, claimed_at long", "size long, mtime long, done boolean", "append", GroupStateTimeout.NoTimeout)


def job_table(events: DataFrame, now: float, grace: float = 60.0) -> DataFrame:
    """Jobs by their last event (`job`, `seq`, `state`, `at`, `lease_seconds`): a running job whose lease and grace are over is pending again."""
    last = events.groupBy("job").agg(F.max_by(F.struct("state", "at", "lease_seconds"), "seq").alias("l"), F.min("seq").alias("created"))
    expired = (F.col("l.state") == "running") & (F.col("l.at") + F.coalesce("l.lease_seconds", F.lit(0.0)) + grace < now)
    return last.select("job", F.when(expired, F.lit("pending")).otherwise(F.col("l.state")).alias("state"), "created")


def jobs_stream(events: DataFrame, grace: float = 60.0) -> DataFrame:
    """Streaming form: per job its last event; a running job whose lease and grace are over, by the clock of the stream, comes out as pending again.

    Rows are (`job`, `state`, `at`), one for each change.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, now, name = state.get if state.exists else (-1, 0.0, "")
        out = []
        if state.hasTimedOut:
            if name == "running":
                name = "pending"
                out.append((key[0], name, now))
        else:
            for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
                if r.seq <= seq:
                    continue  # told before
                seq, now, name = int(r.seq), float(r.at), r.state
                out.append((key[0], name, now))
                if name == "running":
                    lease = 0.0 if pd.isna(r.lease_seconds) else float(r.lease_seconds)
                    state.setTimeoutDuration(max(1, int((lease + grace) * 1000)))
        state.update((seq, now, name))
        yield pd.DataFrame(out, columns=["job", "state", "at"])

    return events.groupBy("job").applyInPandasWithState(step, "job string, state string, at double", "seq long, at double, name string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def outbox_batch(send: Callable[[str, str], int], table_path: str, clock: Callable[[], float]) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: messages (`msg_id`, `body`) are written to the table of tries before they are sent, then sent with what is due, at least once.

    The table holds a row per try (`msg_id`, `body`, `attempt`, `status`, `at`); attempt 0 is the message itself.
    A batch that comes again finds its messages in the table. Messages are sent where their rows lie, not on the driver.
    """
    schema = "msg_id string, body string, attempt int, status int, at double"

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(schema).parquet(table_path) if _written(spark, table_path) else spark.createDataFrame([], schema)
        fresh = batch.select("msg_id", "body").dropDuplicates(["msg_id"]).join(known.select("msg_id"), "msg_id", "left_anti")
        fresh.select("msg_id", "body", F.lit(0).alias("attempt"), F.lit(0).alias("status"), F.lit(clock()).alias("at")).write.mode("append").parquet(table_path)
        tries = spark.read.schema(schema).parquet(table_path)
        state = deliveries(tries.where("attempt > 0").select("msg_id", "attempt", "status", "at"))
        waiting = tries.where("attempt = 0").select("msg_id", "body").join(state, "msg_id", "left")
        now = clock()
        due = waiting.where((F.col("state").isNull()) | ((F.col("state") == "waiting") & (F.col("next_at") <= now)))
        counts = tries.groupBy("msg_id").agg(F.max("attempt").alias("last"))
        sent = F.pandas_udf(lambda ids, bodies: pd.Series([send(i, b) for i, b in zip(ids, bodies)]), "int")
        rows = due.join(counts, "msg_id").select("msg_id", "body", (F.col("last") + 1).alias("attempt"), sent("msg_id", "body").alias("status"), F.lit(now).alias("at"))
        cut_lineage(rows).write.mode("append").parquet(table_path)

    return run


def _written(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema  # noqa: B018
        return True
    except AnalysisException:
        return False


def mailbox_stream(passes: DataFrame, max_bytes: int, max_attempts: int, backfill: bool = False) -> DataFrame:
    """Streaming form of `mailbox_pass`: rows are messages seen in a pass over a box (`box`, `pass_no`, `validity`, `next_uid`, `uid`, `size`, `accepted`).

    The state of a box outlives the stream in its checkpoint. Gives (`box`, `pass_no`, `uid`) for each message that was delivered, once.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saved = json.loads(state.get[0]) if state.exists else {}
        own = {**saved, "retry": {int(k): v for k, v in saved.get("retry", {}).items()}} if saved else {}
        out = []
        for number, seen in pd.concat(list(batches)).sort_values("pass_no").groupby("pass_no"):
            messages = seen[seen["uid"].notna()]
            box = {"validity": int(seen["validity"].iloc[0]), "next": int(seen["next_uid"].iloc[0]), "messages": {int(u): int(s) for u, s in zip(messages["uid"], messages["size"])}}
            taken = {int(u): bool(a) for u, a in zip(messages["uid"], messages["accepted"])}
            own, done = mailbox_pass(own, box, max_bytes, max_attempts, backfill, deliver=lambda uid, taken=taken: taken.get(uid, False))
            out += [(key[0], int(number), uid) for uid in done]
        state.update((json.dumps(own),))
        yield pd.DataFrame(out, columns=["box", "pass_no", "uid"])

    return passes.groupBy("box").applyInPandasWithState(step, "box string, pass_no long, uid long", "saved string", "append", GroupStateTimeout.NoTimeout)


def log_faults(log: DataFrame) -> DataFrame:
    """What is wrong with event logs (`run`, `seq`, `event`): `gap` where a number is missing or comes twice, `late` after the end, `open` where a run doesn't end with 'run.finished'."""
    w = Window.partitionBy("run").orderBy("seq")
    marked = log.select("run", "seq", "event", F.row_number().over(w).alias("n"), F.lead("event").over(w).alias("after"))
    gap = F.when(F.col("seq") != F.col("n") - 1, F.lit("gap"))
    late = F.when((F.col("event") == "run.finished") & F.col("after").isNotNull(), F.lit("late"))
    left = F.when((F.col("event") != "run.finished") & F.col("after").isNull(), F.lit("open"))
    return marked.select("run", "seq", F.explode(F.array_compact(F.array(gap, late, left))).alias("fault"))


def next_jobs(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The oldest pending jobs."""
    return jobs.where("state = 'pending'").orderBy("created", "job").limit(n)


def deliveries(attempts: DataFrame) -> DataFrame:
    """Outbox rows (`msg_id`, `attempt`, `status`, `at`) as the last state: done, failed, or waiting with the time of the next try."""
    last = attempts.groupBy("msg_id").agg(F.max_by(F.struct("status", "at"), "attempt").alias("l"), F.count("*").alias("tries"))
    ok, gone = F.col("l.status").between(200, 299), F.col("l.status") == 410
    delay = F.try_element_at(F.array(*map(F.lit, RETRY_SECONDS)), F.col("tries").cast("int"))
    state = F.when(ok, F.lit("done")).when(gone | delay.isNull(), F.lit("failed")).otherwise(F.lit("waiting"))
    return last.select("msg_id", state.alias("state"), F.when(state == "waiting", F.col("l.at") + delay).alias("next_at"))


def mailbox_pass(state: dict, box: dict, max_bytes: int, max_attempts: int, backfill: bool = False, refuse=lambda uid: False, deliver=lambda uid: True) -> tuple[dict, list[int]]:
    """One pass over a mailbox: {'validity', 'next', 'messages': uid -> bytes}. Gives the new state and the uids delivered.

    A new validity starts over (from the end, unless `backfill`). The queue is what is to
    be retried and what is newer than the last uid; too large or too often failed messages
    are parked, refused ones dropped, vanished ones forgotten.
    """
    if state.get("validity") != box["validity"]:
        state = {"validity": box["validity"], "last": 0 if backfill else box["next"] - 1, "retry": {}, "parked": []}
    last, retry, parked = state["last"], dict(state["retry"]), set(state["parked"])
    done = []
    for uid in sorted(set(retry) | {u for u in box["messages"] if u > last}):
        size = box["messages"].get(uid)
        if size is None or refuse(uid):
            retry.pop(uid, None)
        elif size > max_bytes:
            retry.pop(uid, None)
            parked.add(uid)
        elif deliver(uid):
            retry.pop(uid, None)
            done.append(uid)
        else:
            tries = retry.pop(uid, 0) + 1
            if tries >= max_attempts:
                parked.add(uid)
            else:
                retry[uid] = tries
        last = max(last, uid)
    return {"validity": state["validity"], "last": last, "retry": retry, "parked": sorted(parked)}, done


def event_log(events: DataFrame, order: list[str]) -> DataFrame:
    """An append-only log with numbers from 0 without gaps, per run."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("run").orderBy(*order)) - 1)


def hourly_stream(spark: SparkSession, sf_dir: str, out: str, checkpoint: str) -> DataFrame:
    """Events read as a stream: repeats dropped within a watermark, counted by hour and type, written as a table and read back."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    timed = rows.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    once = timed.dropDuplicatesWithinWatermark(["event_id"])
    query = once.select("event_id", "event_type", "at").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.parquet(out)
    return done.groupBy(F.date_trunc("hour", "at").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))
