"""Change capture and replay of fleet snapshots.

A cycle is one poll of the feed. Encoding compares a vehicle with itself in the
neighbouring cycle through an equi-join on (vehicle, cycle), a unique key, so a
busy vehicle or a full cycle never lands in one task. Replay works per
(vehicle, keyframe interval): a keyframe resets the state, which bounds a group
by the keyframe spacing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.values import last_token
from fleetlens.operators.scale import bucket, number_rows, running_total, small, with_previous
from fleetlens.schemas import DYNAMIC_FIELDS, VEHICLE, VEHICLE_FIELDS

KEYFRAME_EVERY = 100
GAP_S = 600
CARRY_S = 900
CYCLES_PER_BUCKET = 86_400
FRAMES_PER_BUCKET = 1_024
LINE_CHANGES = 20_000


def number_cycles(snapshots: DataFrame, cycle: str = "frame_ts") -> DataFrame:
    """cycle → dense cycle_no, 0-based."""
    cycles = snapshots.select(cycle).distinct().withColumn("_b", bucket(F.col(cycle), CYCLES_PER_BUCKET))
    return number_rows(cycles, [], "_b", [cycle], "cycle_no").drop("_b")


def mark_keyframes(cycles: DataFrame, every: int = KEYFRAME_EVERY, gap_s: int = GAP_S, cycle: str = "frame_ts") -> DataFrame:
    """cycle, cycle_no, gap_s (seconds since the previous cycle), keyframe.

    Keyframes fall on every n-th cycle counted from the start, and after a gap
    longer than ``gap_s``.
    """
    c = cycles.withColumn("_b", bucket(F.col("cycle_no"), CYCLES_PER_BUCKET))
    c = with_previous(c, [], "_b", ["cycle_no"], [cycle], "_prev")
    since = F.col(cycle) - F.col(f"_prev.{cycle}")
    return (
        c.withColumn("since_s", since)
        .withColumn("after_gap", F.coalesce(F.col("since_s") > gap_s, F.lit(False)))
        .withColumn("keyframe", F.col("after_gap") | (F.col("cycle_no") % every == 0))
        .drop("_prev", "_b")
    )


def gap_records(marked: DataFrame, cycle: str = "frame_ts") -> DataFrame:
    """One record per gap, placed right before the keyframe it forces."""
    return marked.where("after_gap").select(
        "cycle_no",
        F.col(cycle).alias("t"),
        F.lit(True).alias("gap"),
        F.col("since_s").alias("gap_seconds"),
        F.lit("restart").alias("reason"),
    )


def change_rows(snapshots: DataFrame, cycles: DataFrame, cycle: str = "frame_ts", dynamic: list[str] | None = None) -> DataFrame:
    """Long form of the delta stream: cycle_no, op, id, vehicle, changed.

    ``snapshots``: one row per (cycle, id) with the vehicle fields.
    ``cycles``: output of ``mark_keyframes``. Keyframe cycles emit every vehicle
    as "new"; other cycles emit "new", "del" and "upd"; ``changed`` lists the
    fields that differ.
    """
    dyn = [c for c in (dynamic or DYNAMIC_FIELDS) if c in snapshots.columns]
    fields = [c for c in VEHICLE_FIELDS if c in snapshots.columns]
    calendar = small(cycles.select(cycle, "cycle_no", "keyframe"))
    here = snapshots.join(calendar, cycle).select(
        "id", "cycle_no", "keyframe", F.struct(*fields).alias("cur")
    )
    earlier = here.select("id", (F.col("cycle_no") + 1).alias("cycle_no"), F.col("cur").alias("prev"))
    both = here.join(earlier, ["id", "cycle_no"], "full_outer")
    differs = lambda c: ~F.col(f"cur.{c}").eqNullSafe(F.col(f"prev.{c}"))
    changed = F.filter(F.array(*[F.when(differs(c), F.lit(c)) for c in dyn]), lambda x: x.isNotNull())
    gone = F.col("cur").isNull()
    rows = (
        both.withColumn("changed", F.when(F.col("cur").isNotNull() & F.col("prev").isNotNull(), changed))
        .withColumn(
            "op",
            F.when(gone, "del")
            .when(F.col("prev").isNull() | F.col("keyframe"), "new")
            .when(F.size("changed") > 0, "upd"),
        )
        .where("op is not null")
    )
    # a disappearance belongs to the following cycle, unless that is a keyframe or lies beyond the end
    plain = small(cycles.where("not keyframe").select("cycle_no", F.lit(True).alias("_plain")))
    out = rows.join(plain, "cycle_no", "left").where((F.col("op") != "del") | F.col("_plain"))
    sparse = F.struct(
        *[
            (
                F.col(f"cur.{c}")
                if c in ("id", "ts")
                else F.when(F.array_contains("changed", c), F.col(f"cur.{c}")) if c in dyn else F.lit(None).cast(VEHICLE[c].dataType)
            ).alias(c)
            for c in fields
        ]
    )
    return out.select(
        "cycle_no",
        "op",
        "id",
        F.when(F.col("op") == "new", F.col("cur")).when(F.col("op") == "upd", sparse).alias("vehicle"),
        F.when(F.col("op") == "upd", F.col("changed")).alias("changed"),
    )


def encode_deltas(
    snapshots: DataFrame, cycles: DataFrame, cycle: str = "frame_ts", changes_per_line: int = LINE_CHANGES
) -> DataFrame:
    """Frames with new, del and upd lists; an unchanged cycle yields an empty frame.

    A frame is one or more lines with the same t and ``part`` from 0. Their number follows from
    the vehicles of the cycle and of the one before, which bound the changes, so that no task
    gathers a whole cycle of unlimited size and the changes are derived once.
    """
    tops = snapshots.groupBy(cycle).agg(F.max("ts").alias("t"), F.count(F.lit(1)).alias("_n"))
    head = cycles.select(cycle, "cycle_no", "keyframe").join(small(tops), cycle, "left")
    before = head.select((F.col("cycle_no") + 1).alias("cycle_no"), F.col("_n").alias("_m"))
    most = F.coalesce("_n", F.lit(0)) + F.coalesce("_m", F.lit(0))
    head = head.join(before, "cycle_no", "left").withColumn("_parts", F.greatest(F.ceil(most / F.lit(changes_per_line)), F.lit(1)).cast("int"))
    changes = change_rows(snapshots, cycles, cycle)
    placed = changes.join(small(head.select("cycle_no", "_parts")), "cycle_no").withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
    listed = lambda op, what: F.array_sort(F.collect_list(F.when(F.col("op") == op, what)))
    lists = placed.groupBy("cycle_no", "part").agg(
        listed("new", F.col("vehicle")).alias("new"),
        listed("del", F.col("id")).alias("del"),
        listed("upd", F.col("vehicle")).alias("upd"),
    )
    lines = head.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    empty = lambda c, like: F.coalesce(c, F.array().cast(like))
    types = {f.name: f.dataType for f in lists.schema.fields}
    return lines.join(lists, ["cycle_no", "part"], "left").select(
        "cycle_no",
        F.coalesce("t", F.lit(0)).alias("t"),
        "part",
        "keyframe",
        *[empty(F.col(c), types[c]).alias(c) for c in ("new", "del", "upd")],
    )


def recording(frames: DataFrame, gaps: DataFrame) -> DataFrame:
    """Frames and gap records in file order: ``frame_no`` sorts gaps right before their keyframe.

    Only counts per cycle are ordered, so that no task gathers the lists of the lines. Lines of
    one cycle and part, of which there is one by rule, are numbered among themselves.
    """
    f = frames.withColumn("_rank", F.col("part") + 1)
    g = gaps.withColumn("_rank", F.lit(0)).withColumn("part", F.lit(0))
    both = f.unionByName(g, allowMissingColumns=True)
    begins = lambda df: df.groupBy("cycle_no").agg(F.count_if(F.col("part") == 0).alias("_n"))
    cycles = begins(f).withColumnRenamed("_n", "_f").join(begins(g).withColumnRenamed("_n", "_g"), "cycle_no", "full_outer").na.fill(0, ["_f", "_g"])
    cycles = cycles.withColumns({"_b": bucket(F.col("cycle_no"), CYCLES_PER_BUCKET), "_starts": F.col("_f") + F.col("_g")})
    cycles = running_total(cycles, [], "_b", ["cycle_no"], "_starts", "_upto").select("cycle_no", "_f", "_g", (F.col("_upto") - F.col("_starts")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("cycle_no", "_rank").orderBy(*(["t"] if "t" in both.columns else ["part"])))
    own = F.when(F.col("_rank") == 0, F.col("_place")).when(F.col("_rank") == 1, F.col("_g") + F.col("_place")).otherwise(F.col("_g") + F.col("_f"))
    numbered = both.withColumn("_place", place).join(small(cycles), "cycle_no").withColumn("frame_no", F.col("_before") + own - 1)
    return numbered.drop("_rank", "_place", "_f", "_g", "_before")


def sample_frames(frames: DataFrame, interval_s: int, per_file: bool = False, clock: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """frame_no of the frames that yield a snapshot.

    Keyframes always do and restart the clock; other frames do when at least
    ``interval_s`` passed since the last one. The clock restarts at every
    keyframe, so each keyframe interval is walked on its own. ``clock`` is a row (last) with
    the time of the frame kept last before these, for frames ahead of the first keyframe.
    """
    light = _frames_only(frames).where("part = 0").select("frame_no", "part", "t", "keyframe", *(["file"] if per_file else []))
    f = _with_reset(light, per_file, reset_index(frames, per_file) if index is None else index)
    walk = F.array_sort(F.collect_list(F.struct("frame_no", "t", F.coalesce("keyframe", F.lit(False)).alias("k"))))
    begun = F.lit(0).cast("long")
    if clock is not None:
        f = f.join(small(clock.select(F.lit(0).cast("long").alias("reset_no"), "last")), "reset_no", "left")
        begun = F.coalesce(F.max("last"), begun)
    start = F.struct(begun.alias("last"), F.expr("cast(array() as array<struct<frame_no:bigint,t:bigint>>)").alias("kept"))
    take = lambda acc, x: x["k"] | ((x["t"] - acc["last"]) >= interval_s)
    fold = lambda acc, x: F.when(
        take(acc, x),
        F.struct(
            x["t"].alias("last"),
            F.concat(acc["kept"], F.array(F.struct(x["frame_no"].alias("frame_no"), x["t"].alias("t")))).alias("kept"),
        ),
    ).otherwise(acc)
    lists = f.groupBy("reset_no").agg(walk.alias("walk"), start.alias("start"))
    kept = lists.select("reset_no", F.aggregate("walk", F.col("start"), fold, lambda acc: acc["kept"]).alias("kept"))
    return kept.select("reset_no", F.explode("kept").alias("s")).select("reset_no", "s.frame_no", F.col("s.t").alias("frame_ts"))


def reset_index(frames: DataFrame, per_file: bool = False) -> DataFrame:
    """Keyframe intervals as frame ranges: reset_no, first, last, and the bucket of frames a part of the range lies in.

    Only the frames' numbers and marks are read. Interval 0 holds the frames ahead of the first reset.
    """
    light = _frames_only(frames)
    starts = light.where(F.coalesce("keyframe", F.lit(False)) & (F.col("part") == 0)).select("frame_no")
    if per_file:
        starts = starts.unionByName(light.groupBy("file").agg(F.min("frame_no").alias("frame_no")).select("frame_no"))
    starts = starts.distinct().withColumn("_b", bucket(F.col("frame_no"), CYCLES_PER_BUCKET))
    numbered = number_rows(starts, [], "_b", ["frame_no"], "_n").select((F.col("_n") + 1).alias("reset_no"), F.col("frame_no").alias("first"))
    ends = light.agg(F.min("frame_no").alias("first"), F.max("frame_no").alias("_end")).where("first is not null")
    every = numbered.unionByName(ends.select(F.lit(0).cast("long").alias("reset_no"), "first"))
    following = numbered.select((F.col("reset_no") - 1).alias("reset_no"), (F.col("first") - 1).alias("last"))
    ranges = every.join(following, "reset_no", "left").withColumn("_k", F.lit(0)).join(small(ends.select(F.lit(0).alias("_k"), "_end")), "_k")
    ranges = ranges.select("reset_no", "first", F.coalesce("last", "_end").alias("last")).where("last >= first")
    width = F.lit(FRAMES_PER_BUCKET)
    return ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))


def _with_reset(frames: DataFrame, per_file: bool = False, index: DataFrame | None = None) -> DataFrame:
    """reset_no: number of state resets up to and including the frame (parts of a frame share it).

    A keyframe resets; with ``per_file`` the first frame of a file does too. Frames look their interval up in
    the index, so that what they carry is neither ordered nor moved.
    """
    index = small(reset_index(frames, per_file) if index is None else index)
    inside = (F.floor(F.col("frame_no") / FRAMES_PER_BUCKET) == F.col("bucket")) & F.col("frame_no").between(F.col("first"), F.col("last"))
    return frames.join(index, inside).drop("bucket", "first", "last")


def _frames_only(frames: DataFrame) -> DataFrame:
    kept = frames.where("not coalesce(gap, false)") if "gap" in frames.columns else frames
    return kept.withColumn("part", F.coalesce("part", F.lit(0))) if "part" in kept.columns else kept.withColumn("part", F.lit(0))


def change_events(frames: DataFrame, per_file: bool = False, index: DataFrame | None = None) -> DataFrame:
    """(reset_no, frame_no, _step, op, id, vehicle): additions, then removals, then updates of a frame."""
    f = _with_reset(_frames_only(frames), per_file, index)
    vehicle = f.schema["new"].dataType.elementType
    row = lambda step, op, id_, v: F.struct(F.lit(step).alias("_step"), F.lit(op).alias("op"), id_.alias("id"), v.cast(vehicle).alias("vehicle"))
    adds = F.transform("new", lambda v: row(0, "new", v["id"], v))
    dels = F.transform("del", lambda v: row(1, "del", v, F.lit(None)))
    ups = F.transform("upd", lambda v: row(2, "upd", v["id"], v))
    none = F.array().cast("array<struct<_step:int,op:string,id:string,vehicle:" + vehicle.simpleString() + ">>")
    plain = ~F.coalesce("keyframe", F.lit(False))
    parts = [F.coalesce(adds, none)] + [F.when(plain, F.coalesce(x, none)).otherwise(none) for x in (dels, ups)]
    return f.select("reset_no", "frame_no", F.explode(F.concat(*parts)).alias("e")).select("reset_no", "frame_no", "e._step", "e.op", "e.id", "e.vehicle")


def keep_lines(events: DataFrame, label_map: DataFrame, lines: list[str]) -> DataFrame:
    """Only additions of the wanted lines; an addition off-line becomes a removal.

    Runs before the replay window, so other vehicles are never ordered. Updates
    and removals of vehicles never added on a wanted line are dropped.
    """
    wanted = label_map.where(F.col("line").isin(lines)).select(F.col("suffix").alias("_suffix"), F.lit(True).alias("_ours"))
    tagged = events.withColumn("_suffix", last_token(F.col("vehicle.label"))).join(small(wanted), "_suffix", "left")
    is_new = F.col("op") == "new"
    turned = tagged.withColumn("op", F.when(is_new & F.col("_ours").isNull(), "del").otherwise(F.col("op"))).withColumn(
        "vehicle", F.when(F.col("op") != "del", F.col("vehicle"))
    )
    ours = turned.where("op = 'new'").select("id").distinct()
    return turned.drop("_ours", "_suffix").join(small(ours), "id", "left_semi")


def vehicle_lives(events: DataFrame) -> DataFrame:
    """State intervals: one row per change with all fields as known after it, valid for
    frames in [from_frame, to_frame) of its reset.

    A life starts with an addition and ends with a removal or the reset's end;
    updates before any addition are ignored.
    """
    by = Window.partitionBy("reset_no", "id").orderBy("frame_no", "_step")
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    marked = events.withColumn("_life", F.sum(F.when(F.col("op") == "upd", 0).otherwise(1)).over(run)).where("_life > 0")
    state = Window.partitionBy("reset_no", "id", "_life").orderBy("frame_no", "_step")
    known = state.rowsBetween(Window.unboundedPreceding, 0)
    fields = [c for c in events.schema["vehicle"].dataType.names if c != "id"]
    rows = marked.select(
        "reset_no",
        "id",
        "frame_no",
        "op",
        "_life",
        F.first("op").over(state).alias("_start"),
        F.lead("frame_no").over(by).alias("to_frame"),
        *[F.last(f"vehicle.{c}", ignorenulls=True).over(known).alias(c) for c in fields],
    )
    return rows.where("_start = 'new' and op <> 'del'").withColumnRenamed("frame_no", "from_frame").drop("_start", "_life", "op")


def replay(
    frames: DataFrame,
    interval_s: int = 300,
    label_map: DataFrame | None = None,
    lines: list[str] | None = None,
    per_file: bool = False,
) -> DataFrame:
    """One row per (kept frame, vehicle): frame_no, frame_ts, id and the vehicle's fields.

    With ``lines`` only vehicles of those lines are replayed. The state runs on
    over file borders; ``per_file`` starts every file empty.
    """
    events = change_events(frames, per_file)
    if lines is not None:
        events = keep_lines(events, label_map, lines)
    return _at_frames(vehicle_lives(events), sample_frames(frames, interval_s, per_file))


def _at_frames(lives: DataFrame, kept: DataFrame) -> DataFrame:
    """The vehicles alive in each kept frame, with what is known of them by then."""
    lives = lives.where("to_frame is null or to_frame > from_frame")
    # a reset holds at most the frames between two keyframes; the list is bounded by their spacing
    ticks = kept.groupBy("reset_no").agg(F.array_sort(F.collect_list(F.struct("frame_no", "frame_ts"))).alias("_ticks"))
    inside = F.filter(
        "_ticks",
        lambda k: (k["frame_no"] >= F.col("from_frame")) & (F.col("to_frame").isNull() | (k["frame_no"] < F.col("to_frame"))),
    )
    fields = [c for c in lives.columns if c not in ("reset_no", "id", "from_frame", "to_frame")]
    placed = lives.join(small(ticks), "reset_no").withColumn("_k", F.explode(inside))
    return placed.select(F.col("_k.frame_no").alias("frame_no"), F.col("_k.frame_ts").alias("frame_ts"), "id", *fields)


def replay_step(
    frames: DataFrame, interval_s: int, fleet: DataFrame | None, clock: DataFrame | None, hold: Callable[[DataFrame], DataFrame] = lambda df: df
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(snapshots, fleet, clock): frames that may begin anywhere, replayed on from the state that earlier ones left.

    ``fleet`` holds the vehicles alive (id and fields), one row each; ``clock`` one row (last) with the time of the frame kept
    last. Both are None at the start. The fleet enters as additions ahead of the first frame, in interval 0, which a
    keyframe among these frames ends like any other. Without frames the state stays as it is. ``hold`` may keep
    what is read several times.
    """
    index = hold(reset_index(frames))
    events = change_events(frames, index=index)
    kind = events.schema["vehicle"].dataType
    if fleet is not None:
        vehicle = F.struct(*[F.col(c).cast(kind[c].dataType).alias(c) for c in kind.names])
        old = fleet.select(F.lit(0).cast("long").alias("reset_no"), F.lit(-1).cast("long").alias("frame_no"), F.lit(0).alias("_step"), F.lit("new").alias("op"), "id", vehicle.alias("vehicle"))
        events = events.unionByName(old)
    lives = hold(vehicle_lives(events))
    kept = hold(sample_frames(frames, interval_s, clock=clock, index=index))
    newest = index.agg(F.coalesce(F.max("reset_no"), F.lit(0)).alias("reset_no"))
    alive = lives.where("to_frame is null").join(small(newest), "reset_no", "left_semi").select("id", *[c for c in kind.names if c != "id"])
    times = kept.select("frame_no", F.col("frame_ts").alias("last"))
    if clock is not None:
        times = times.unionByName(clock.select(F.lit(-1).cast("long").alias("frame_no"), "last"))
    return _at_frames(lives, kept), alive, times.agg(F.max_by("last", "frame_no").alias("last"))


def observations(snapshots: DataFrame, dedupe: bool = True) -> DataFrame:
    """Per vehicle and frame: ts falls back to the frame's time.

    A vehicle that stopped reporting repeats its ts in every snapshot;
    ``dedupe`` keeps the first frame of each (vehicle, ts).
    """
    obs = snapshots.withColumnRenamed("id", "vehicle_id").withColumn("ts", F.coalesce("ts", "frame_ts"))
    if not dedupe:
        return obs
    fields = [c for c in obs.columns if c not in ("vehicle_id", "ts")]
    return (
        obs.groupBy("vehicle_id", "ts").agg(F.min_by(F.struct(*fields), "frame_no").alias("o")).select("vehicle_id", "ts", "o.*")
    )


def with_carry(obs: DataFrame, window_s: int = CARRY_S, day: str = "day") -> DataFrame:
    """Prepend the last ``window_s`` of each vehicle's day to its next calendar day; adds carried."""
    ends = obs.groupBy("vehicle_id", day).agg(F.max("ts").alias("_end"))
    tail = (
        obs.join(ends, ["vehicle_id", day])
        .where(F.col("ts") >= F.col("_end") - window_s)
        .drop("_end")
        .withColumn(day, F.date_format(F.date_add(F.to_date(day), 1), "yyyy-MM-dd"))
        .withColumn("carried", F.lit(True))
    )
    days = obs.select(day).distinct()
    return obs.withColumn("carried", F.lit(False)).unionByName(tail.join(small(days), day, "left_semi"))


def frame_counts(frames: DataFrame) -> DataFrame:
    """Counters per cycle, and the vehicles in sight; parts of one frame are summed.

    A keyframe lists its vehicles, other frames add and remove some, so the count runs on within a keyframe interval.
    """
    sized = lambda c: F.sum(F.coalesce(F.size(c), F.lit(0)))
    counts = (
        _frames_only(frames)
        .groupBy("cycle_no", "t", F.coalesce("keyframe", F.lit(False)).alias("keyframe"))
        .agg(sized("new").alias("n_new"), sized("del").alias("n_del"), sized("upd").alias("n_upd"))
    )
    cycles = counts.select(F.col("cycle_no").alias("frame_no"), "keyframe", F.lit(0).alias("part"))
    interval = _with_reset(cycles).select(F.col("frame_no").alias("cycle_no"), "reset_no")
    run = Window.partitionBy("reset_no").orderBy("cycle_no").rowsBetween(Window.unboundedPreceding, 0)
    return counts.join(interval, "cycle_no").withColumn("n_vehicles", F.sum(F.col("n_new") - F.col("n_del")).over(run)).drop("reset_no")


def change_rates(prev: DataFrame, curr: DataFrame, fields: list[str]) -> DataFrame:
    """Per field: how many vehicles present on both sides differ, and in percent; plus presence counts."""
    p = prev.select("id", F.struct(*fields).alias("p"))
    c = curr.select("id", F.struct(*fields).alias("c"))
    both = p.join(c, "id", "full_outer")
    common = F.col("p").isNotNull() & F.col("c").isNotNull()
    diff = lambda f: ~F.col(f"p.{f}").eqNullSafe(F.col(f"c.{f}"))
    any_diff: Column = F.lit(False)
    for f in fields:
        any_diff = any_diff | diff(f)
    totals = both.agg(
        F.sum(F.when(common, 1).otherwise(0)).alias("n_common"),
        F.sum(F.when(F.col("p").isNull(), 1).otherwise(0)).alias("n_new"),
        F.sum(F.when(F.col("c").isNull(), 1).otherwise(0)).alias("n_deleted"),
        F.sum(F.when(common & ~any_diff, 1).otherwise(0)).alias("n_unchanged"),
        *[F.sum(F.when(common & diff(f), 1).otherwise(0)).alias(f"_{f}") for f in fields],
    )
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("n_changed")) for f in fields])
    return totals.select("n_common", "n_new", "n_deleted", "n_unchanged", F.explode(pairs).alias("x")).select(
        "x.*", (F.col("x.n_changed") * 100.0 / F.greatest("n_common", F.lit(1))).alias("pct_changed"),
        "n_common", "n_new", "n_deleted", "n_unchanged",
    )


def max_fleet_per_line(snapshots: DataFrame, frame: str = "frame_ts") -> DataFrame:
    """Most vehicles of a line seen in one frame."""
    per_frame = snapshots.where("line is not null").groupBy("line", frame).agg(F.count(F.lit(1)).alias("n"))
    return per_frame.groupBy("line").agg(F.max("n").alias("max_vehicles"), F.count(F.lit(1)).alias("n_frames"))
