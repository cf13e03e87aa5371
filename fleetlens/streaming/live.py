"""Continuous versions of the capture, cache and arrival operators.

State that spans micro-batches is a versioned table on shared storage: batch n
reads version n-1 and writes version n, so a batch repeated after a failure
starts from the same state and overwrites its own output. Version n-2 is then
removed. The per-batch work is the batch operator itself, distributed as usual.

A feed is a sequence of cycles, each with all vehicles in sight. What is kept of a
vehicle leaves with the first cycle that doesn't list it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.operators import capture
from fleetlens.operators.arrivals import arrival_board
from fleetlens.operators.scale import small

HISTORY = 10
HISTORY_S = 300
PREDICTION_TTL_S = 600
SEEN_S = 86_400


class Versions:
    """Numbered snapshots of a small state table."""

    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")

    def before(self, batch: DataFrame, batch_id: int) -> DataFrame | None:
        if batch_id == 0:
            return None
        # a version that is gone raises: starting over would lose everything carried
        return batch.sparkSession.read.parquet(f"{self.root}/v={batch_id - 1}")

    def write(self, state: DataFrame, batch_id: int) -> DataFrame:
        path = f"{self.root}/v={batch_id}"
        state.write.mode("overwrite").parquet(path)
        self._remove(state.sparkSession, batch_id - 2)  # the last batch may be repeated, the ones before it are committed
        return state.sparkSession.read.parquet(path)

    def _remove(self, spark: SparkSession, version: int) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v={version}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def numbers(self, spark: SparkSession) -> list[int]:
        """Versions that are there, in order."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        return sorted(int(f.getPath().getName()[2:]) for f in found if f.getPath().getName().startswith("v="))

    def newest(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/v={self.numbers(spark)[-1]}")


def _write_batch(rows: DataFrame, out: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")


@contextmanager
def holding() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Keep tables that a batch reads several times until it is done; a lost block is derived again."""
    held: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return held[-1]

    try:
        yield hold
    finally:
        for df in held:
            df.unpersist()


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    def run(batch: DataFrame, batch_id: int) -> None:
        # a batch is read several times; a lost block is read again from the source
        kept = batch.persist()
        try:
            each(kept, batch_id)
        finally:
            kept.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def stream_deltas(
    stream: DataFrame, out: str, state: str, checkpoint: str, every: int = capture.KEYFRAME_EVERY, gap_s: int = capture.GAP_S,
    gaps_out: str | None = None, once: bool = True, cycle: str = "frame_ts",
) -> StreamingQuery:
    """Change rows of a live snapshot stream (and gap records, if asked for).

    The last cycle of the previous batch is the state: it is put in front of
    the new cycles and its own changes are left out. Cycles must be complete
    within a batch.
    """
    versions = Versions(state)

    def each(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.withColumn("cycle_no", F.lit(None).cast("long"))
        last = versions.before(batch, batch_id)
        rows = fresh if last is None else last.unionByName(fresh)
        numbered = capture.number_cycles(rows.drop("cycle_no"), cycle)
        start = rows.agg(F.coalesce(F.max("cycle_no"), F.lit(0)).alias("_start")).withColumn("_k", F.lit(0))
        cycles = (
            numbered.withColumn("_k", F.lit(0)).join(small(start), "_k").withColumn("cycle_no", F.col("cycle_no") + F.col("_start")).drop("_k")
        )
        marked = capture.mark_keyframes(cycles, every, gap_s, cycle)
        known = marked if last is None else marked.where("cycle_no > _start")
        changes = capture.change_rows(rows.drop("cycle_no"), marked, cycle).join(small(known.select("cycle_no")), "cycle_no", "left_semi")
        _write_batch(changes, out, batch_id)
        if gaps_out:
            _write_batch(capture.gap_records(known, cycle), gaps_out, batch_id)
        top = cycles.agg(F.max(cycle).alias(cycle))
        versions.write(rows.drop("cycle_no").join(small(top), cycle, "left_semi").join(small(cycles.select(cycle, "cycle_no")), cycle), batch_id)

    return _start(stream, each, checkpoint, once)


def stream_gaps(stream: DataFrame, out: str, state: str, checkpoint: str, gap_s: int = capture.GAP_S, once: bool = True, cycle: str = "frame_ts") -> StreamingQuery:
    """Cycles that follow a silence longer than ``gap_s``: t and gap_seconds."""
    versions = Versions(state)

    def each(batch: DataFrame, batch_id: int) -> None:
        cycles = batch.select(F.col(cycle).cast("long").alias("t")).distinct().withColumn("_new", F.lit(True))
        last = versions.before(batch, batch_id)
        every = cycles if last is None else cycles.unionByName(last.withColumn("_new", F.lit(False)))
        # cycles of one batch: one row per poll of the feed
        linked = every.withColumn("gap_seconds", F.col("t") - F.lag("t").over(Window.orderBy("t")))
        _write_batch(linked.where((F.col("gap_seconds") > gap_s) & F.col("_new")).select("t", "gap_seconds"), out, batch_id)
        versions.write(every.agg(F.max("t").alias("t")), batch_id)

    return _start(stream, each, checkpoint, once)


def live_fleet(rows: DataFrame, order: list[str], cycle: str = "frame_ts", vehicle: str = "vehicle_id") -> DataFrame:
    """The vehicles of the newest cycle, one row each: the last by ``order``."""
    newest = rows.agg(F.max(cycle).alias(cycle))
    now = rows.join(small(newest), cycle, "left_semi")
    rest = [c for c in rows.columns if c != vehicle]
    return now.groupBy(vehicle).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v")).select(vehicle, "v.*").select(*rows.columns)


def refresh_fleet(batch: DataFrame, batch_id: int, state: Versions, order: list[str], cycle: str = "frame_ts") -> DataFrame:
    """The cache after a batch. The state is the newest cycle, so a vehicle it doesn't list is gone, and a late cycle changes nothing."""
    last = state.before(batch, batch_id)
    return state.write(live_fleet(batch if last is None else last.unionByName(batch), order, cycle), batch_id)


def stream_latest(stream: DataFrame, out: str, state: str, checkpoint: str, order: list[str], once: bool = True, cycle: str = "frame_ts") -> StreamingQuery:
    """Latest row of every vehicle in sight, rewritten with each batch."""
    versions = Versions(state)

    def each(batch: DataFrame, batch_id: int) -> None:
        _write_batch(refresh_fleet(batch, batch_id, versions, order, cycle), out, batch_id)

    return _start(stream, each, checkpoint, once)


def recent_positions(rows: DataFrame, k: int = HISTORY, window_s: int = HISTORY_S, tie: str = "event_id") -> DataFrame:
    """Last k rows per vehicle within ``window_s`` of its newest one. The rank limit runs before the shuffle."""
    order = Window.partitionBy("vehicle_id").orderBy(F.col("ts").desc(), F.col(tie).desc())
    top = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    newest = F.max("ts").over(Window.partitionBy("vehicle_id"))
    return top.withColumn("_newest", newest).where(F.col("ts") >= F.col("_newest") - window_s).drop("_r", "_newest")


def stream_history(stream: DataFrame, state: str, checkpoint: str, k: int = HISTORY, window_s: int = HISTORY_S, once: bool = True) -> StreamingQuery:
    """Rolling history per vehicle; the newest state version is the result."""
    versions = Versions(state)

    def each(batch: DataFrame, batch_id: int) -> None:
        last = versions.before(batch, batch_id)
        versions.write(recent_positions(batch if last is None else last.unionByName(batch), k, window_s), batch_id)

    return _start(stream, each, checkpoint, once)


def replay_batch(batch: DataFrame, batch_id: int, out: str, state: str, interval_s: int = 300, keep_s: int = SEEN_S) -> None:
    """Replay one batch of frames on from what the batches before it left, and write its observations.

    Three tables are carried, each a row per vehicle at most: the vehicles alive with all that is known of them, the clock of the
    sampling, and the time each vehicle was last reported with, for a vehicle that stands still is reported
    once. The last is forgotten ``keep_s`` after.
    """
    fleet, clock, seen = (Versions(f"{state.rstrip('/')}/{n}") for n in ("fleet", "clock", "seen"))
    reported = seen.before(batch, batch_id)
    with holding() as hold:
        snapshots, alive, last = capture.replay_step(batch, interval_s, fleet.before(batch, batch_id), clock.before(batch, batch_id), hold)
        fresh = capture.observations(snapshots)
        if reported is not None:
            fresh = fresh.join(reported.select("vehicle_id", "ts"), ["vehicle_id", "ts"], "left_anti")
        _write_batch(fresh, out, batch_id)
        fleet.write(alive, batch_id)
        clock.write(last, batch_id)
    done = batch.sparkSession.read.parquet(f"{out.rstrip('/')}/batch={batch_id}").select("vehicle_id", "ts", "frame_ts")
    every = done if reported is None else done.unionByName(reported)
    newest = every.groupBy("vehicle_id").agg(F.max_by(F.struct("ts", "frame_ts"), F.struct("frame_ts", "ts")).alias("o")).select("vehicle_id", "o.*")
    now = every.agg(F.max("frame_ts").alias("_now")).withColumn("_k", F.lit(0))
    kept = newest.withColumn("_k", F.lit(0)).join(small(now), "_k").where(F.col("_now") - F.col("frame_ts") <= keep_s)
    seen.write(kept.select("vehicle_id", "ts", "frame_ts"), batch_id)


def stream_replay(stream: DataFrame, out: str, state: str, checkpoint: str, interval_s: int = 300, once: bool = True, keep_s: int = SEEN_S) -> StreamingQuery:
    """Frames replayed into observations as they arrive. A batch may begin and end anywhere, also inside a keyframe interval."""
    return _start(stream, lambda batch, batch_id: replay_batch(batch, batch_id, out, state, interval_s, keep_s), checkpoint, once)


def stream_arrivals(
    stream: DataFrame, requests: DataFrame, shapes: DataFrame, paths: DataFrame, lookup: DataFrame, out: str, state: str, checkpoint: str,
    now: int | None = None, once: bool = True, order: list[str] | None = None, cycle: str = "frame_ts",
) -> StreamingQuery:
    """Arrival board over the vehicles in sight, renewed with every batch."""
    versions = Versions(state)

    def each(batch: DataFrame, batch_id: int) -> None:
        live = refresh_fleet(batch, batch_id, versions, order or ["ts"], cycle)
        at = now if now is not None else int(live.agg(F.max("ts")).first()[0] or 0)
        with holding() as hold:
            _write_batch(arrival_board(requests, live, shapes, paths, lookup, at, hold=hold), out, batch_id)

    return _start(stream, each, checkpoint, once)


def stream_predictions(stream: DataFrame, out: str, state: str, checkpoint: str, ttl_s: int = PREDICTION_TTL_S, once: bool = True, order: list[str] | None = None, cycle: str = "frame_ts") -> StreamingQuery:
    """Predictions in force after each batch: of vehicles in sight, and no more than ``ttl_s`` older than the newest cycle."""
    versions = Versions(state)

    def each(batch: DataFrame, batch_id: int) -> None:
        live = refresh_fleet(batch, batch_id, versions, order or ["ts"], cycle)
        _write_batch(live.where(F.col(cycle) - F.col("ts") <= ttl_s), out, batch_id)

    return _start(stream, each, checkpoint, once)


def newest_version(spark: SparkSession, root: str) -> DataFrame:
    """The last state version; only its folder is read."""
    return Versions(root).newest(spark)
