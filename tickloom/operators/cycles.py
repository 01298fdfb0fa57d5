"""Runs, the cycle table with its ledger of drops, sensor roles, pairs and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof, nearest

# Drop reasons in order, what is trainable, veto sources, limits in microseconds.
REASONS = ("udp_drop", "no_command", "untrainable_outcome", "untrainable_status", "vetoed")
OUTCOMES, STATUSES = ("planned",), ("navigating",)
VETO_SOURCES = ("hw_fault", "protective_stop", "stale_timeout")
MAX_AGE_US, VETO_US, CYCLE_US, STEP, JITTER_US = 300_000, 100_000, 100_000, 2, 30_000


def segment_runs(cycles: DataFrame, order: str = "ord") -> DataFrame:
    """Adds ``run_id``: a new run where cycle_id does not rise above the row before it, in write order of its session."""
    w = Window.partitionBy("session").orderBy(order)
    starts = cycles.withColumn("_new", F.when(F.col("cycle_id") <= F.lag("cycle_id").over(w), 1).otherwise(0))
    return starts.withColumn("run_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def run_bounds(cycles: DataFrame) -> DataFrame:
    """First and last tick and number of rows of each run."""
    return cycles.groupBy("session", "run_id").agg(F.min("tick").alias("t_start"), F.max("tick").alias("t_end"), F.count("*").alias("n"))


def run_cover(bounds: DataFrame) -> DataFrame:
    """(session, tick, run_id) of the ticks where the highest run that covers a tick changes; null: none covers it.

    Runs that overlap, directly or through others, form a cluster, and only the runs of a cluster are compared with each other.
    """
    w = Window.partitionBy("session").orderBy("t_start", "run_id")
    reached = F.max("t_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = bounds.select("session", "run_id", "t_start", "t_end").withColumn("_new", F.when(F.col("t_start") <= reached, 0).otherwise(1))
    b = b.withColumn("_cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    points = b.select("session", "_cluster", F.explode(F.array("t_start", F.col("t_end") + 1)).alias("tick")).distinct()
    over = F.when(F.col("tick").between(F.col("t_start"), F.col("t_end")), F.col("run_id"))
    return points.join(b, ["session", "_cluster"]).groupBy("session", "tick").agg(F.max(over).alias("run_id"))


def assign_run(rows: DataFrame, bounds: DataFrame, ts: str = "tick") -> DataFrame:
    """Adds ``run_id`` of the run whose ticks enclose the row's (the highest if several, -1 if none)."""
    cover = run_cover(bounds).select("session", F.col("tick").alias(ts), F.lit(0).alias("ord"), "run_id")
    got = asof(rows, cover, ["session"], ["run_id"], ts=ts)
    return got.select(*rows.columns, F.coalesce("m.run_id", F.lit(-1).cast("long")).alias("run_id"))


def first_written(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The first written row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    low = rows.groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("_o"), *rest)).alias("_r"))
    return low.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def once(counted: str, keys: list[str], what: str) -> Column:
    """True if the number is 1; else the query fails."""
    said = F.concat(F.lit(f"duplicate {', '.join(keys)} in {what}: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    return F.when(F.col(counted) > 1, F.raise_error(said).cast("boolean")).otherwise(F.lit(True))


def vetoed(cycles: DataFrame, executed: DataFrame, tolerance: int = VETO_US, sources: tuple[str, ...] = VETO_SOURCES) -> DataFrame:
    """Adds ``vetoed``: whether the executed command nearest in time, within the tolerance, came from a veto source."""
    got = nearest(cycles.withColumn("ts", F.col("tick")), executed.select("session", F.col("tick").alias("ts"), "ord", "source"), ["session"], ["source"], tolerance)
    return got.withColumn("vetoed", F.coalesce(F.col("m.source").isin(*sources), F.lit(False))).drop("m", "ts")


def label_drops(
    cycles: DataFrame, frontier: DataFrame, commands: DataFrame, executed: DataFrame | None = None, outcomes=OUTCOMES, statuses=STATUSES, veto_us: int = VETO_US, strict: bool = True
) -> DataFrame:
    """Every cycle with its run, command and ``drop_reason`` (null: kept).

    cycles: session, ord, tick, cycle_id, outcome, status, ...; frontier: session, ord, tick, cycle_id, ...; commands: session, ord, tick,
    cycle_id, linear, angular; executed: session, ord, tick, source. The first reason in order counts. strict: a query that
    reads drop_reason fails if a key repeats in cycles or frontier, rows outside runs included. Raises ValueError if a table lacks
    cycle_id, or cycles or frontier are empty.
    """
    for df, what in ((cycles, "cycles"), (frontier, "frontier"), (commands, "commands")):
        if "cycle_id" not in df.columns:
            raise ValueError(f"{what} have no cycle_id: this recording lacks the instrumentation")
    for df, what in ((cycles, "cycles"), (frontier, "frontier")):
        if not df.take(1):
            raise ValueError(f"no {what}: this recording lacks the instrumentation")
    keys = ["session", "run_id", "cycle_id"]
    runs = segment_runs(cycles)
    bounds = run_bounds(runs)
    seen = assign_run(frontier.select("session", "ord", "tick", "cycle_id"), bounds).groupBy(*keys).agg(F.count("*").alias("_n"))
    seen = seen.where((once("_n", keys, "frontier") if strict else F.lit(True)) & (F.col("run_id") >= 0)).select(*keys, F.lit(True).alias("_seen"))
    ordered = commands.where("cycle_id <> -1").select("session", "ord", "tick", "cycle_id", "linear", "angular")
    given = first_written(assign_run(ordered, bounds).where("run_id >= 0"), keys)
    given = given.select(*keys, "linear", "angular", F.lit(True).alias("_given"))
    if strict:
        runs = runs.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(once("_n", keys, "cycles")).drop("_n")
    joined = runs.join(seen, keys, "left").join(given, keys, "left")
    joined = vetoed(joined, executed, veto_us) if executed is not None else joined.withColumn("vetoed", F.lit(False))
    reason = F.when(F.col("_seen").isNull(), REASONS[0]).when(F.col("_given").isNull(), REASONS[1]).when(~F.col("outcome").isin(*outcomes), REASONS[2])
    reason = reason.when(~F.col("status").isin(*statuses), REASONS[3]).when(F.col("vetoed"), REASONS[4])
    return joined.withColumn("drop_reason", reason).drop("_seen", "_given", "vetoed")


def drop_ledger(labelled: DataFrame) -> DataFrame:
    """Number of dropped cycles for every reason, zeros included."""
    spark = labelled.sparkSession
    every = spark.range(len(REASONS)).select(F.element_at(F.array(*map(F.lit, REASONS)), (F.col("id") + 1).cast("int")).alias("drop_reason"))
    counts = labelled.where("drop_reason IS NOT NULL").groupBy("drop_reason").agg(F.count("*").alias("n"))
    return every.join(counts, "drop_reason", "left").select("drop_reason", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def frontier_roles(frontier: DataFrame) -> list[str]:
    """Names of the roles that have an age column."""
    return sorted(c.removeprefix("age_us.") for c in frontier.columns if c.startswith("age_us."))


def unpivot_roles(frontier: DataFrame, keys: list[str], max_age: int | dict[str, int] = MAX_AGE_US) -> DataFrame:
    """A row for each key and role: seq, age_us, ``present`` and ``capture_us`` (-1 if not present). A role without a limit raises."""
    roles = frontier_roles(frontier)
    limit = lambda r: max_age if isinstance(max_age, int) else max_age[r]
    seq = lambda r: F.coalesce(F.col(f"`seq.{r}`").cast("long"), F.lit(-1).cast("long")) if f"seq.{r}" in frontier.columns else F.lit(-1).cast("long")
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), seq(r).alias("seq"), F.col(f"`age_us.{r}`").cast("long").alias("age_us"), F.lit(limit(r)).cast("long").alias("limit")) for r in roles]))
    out = frontier.select(*keys, "tick", rows.alias("r")).select(*keys, "tick", "r.*")
    present = F.coalesce(F.col("age_us").between(F.lit(0), F.col("limit")), F.lit(False))
    out = out.withColumn("present", present)
    capture = F.when(F.col("present"), F.col("tick") - F.col("age_us")).otherwise(F.lit(-1).cast("long"))
    return not_after_tick(out.select(*dict.fromkeys([*keys, "tick"]), "role", "seq", "age_us", "present", capture.alias("capture_us"))).select(*keys, "role", "seq", "age_us", "present", "capture_us")


def not_after_tick(rows: DataFrame) -> DataFrame:
    """The rows (tick, role, present, capture_us, ...) as they are; a query fails if a present capture is later than its own tick."""
    said = F.concat(F.lit("role "), F.col("role"), F.lit(": capture after its own tick"))
    late = F.col("present") & (F.col("capture_us") > F.col("tick"))
    return rows.withColumn("capture_us", F.when(late, F.raise_error(said).cast("long")).otherwise(F.col("capture_us")))


def commanded(cycles: DataFrame) -> DataFrame:
    """Adds ``action``: linear and angular as an array of two floats."""
    return cycles.withColumn("action", F.array(F.col("linear").cast("float"), F.col("angular").cast("float")))


def normalised(cycles: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Each column less its mean, by its deviation; stats: the one row of action_stats."""
    both = cycles.crossJoin(F.broadcast(stats))  # one row
    out = [(F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns]
    return both.select(*[c for c in cycles.columns if c not in columns], *[x.alias(c) for x, c in zip(out, columns, strict=True)])


def with_proprio(cycles: DataFrame, velocity: DataFrame | None, key: str = "velocity_seq") -> DataFrame:
    """Adds measured ``v_linear`` and ``v_angular`` by the first written velocity of the sequence number, 0.0 where there is none."""
    if velocity is None:
        return cycles.withColumns({"v_linear": F.lit(0.0), "v_angular": F.lit(0.0)})
    first = first_written(velocity.select("session", F.col("seq").alias(key), "ord", "v_linear", "v_angular"), ["session", key]).drop("ord")
    return cycles.join(first, ["session", key], "left").fillna(0.0, ["v_linear", "v_angular"])


def step_pairs(kept: DataFrame, step: int = STEP, period: int = CYCLE_US, jitter: int = JITTER_US, valid: Column | None = None) -> DataFrame:
    """Pairs of a surviving cycle with the one ``step`` surviving rows later, if it is exactly ``step`` cycles on in its run, in time, and both valid."""
    w = Window.partitionBy("session").orderBy("run_id", "cycle_id")
    ok = F.lit(True) if valid is None else valid
    nxt = kept.withColumn("_ok", ok).withColumn("_n", F.lead(F.struct("run_id", "cycle_id", "tick", "_ok"), step).over(w))
    fine = (F.col("_n.run_id") == F.col("run_id")) & (F.col("_n.cycle_id") - F.col("cycle_id") == step) & (F.abs(F.col("_n.tick") - F.col("tick") - step * period) <= jitter)
    return nxt.where(fine & F.col("_ok") & F.col("_n._ok")).select("session", "run_id", F.col("cycle_id").alias("cycle_i"), F.col("_n.cycle_id").alias("cycle_j"), F.col("tick").alias("tick_i"), F.col("_n.tick").alias("tick_j"))


def split_by_session(counts: DataFrame, fraction: float = 0.15) -> DataFrame:
    """Of (session, n): adds ``split``; whole trailing sessions are held out until the fraction, rounded half to even, is reached."""
    w = Window.orderBy(F.col("session").desc())  # a row for each session
    every = Window.partitionBy()
    df = counts.withColumn("cum", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(every)).withColumn("m", F.count("*").over(every))
    k = F.sum(F.when(F.col("cum") < F.bround(F.col("total") * fraction), 1).otherwise(0)).over(every) + 1
    df = df.withColumn("k", F.least(F.greatest(k, F.lit(1)), F.col("m") - 1)).withColumn("r", F.row_number().over(w))
    held = (F.col("total") > 0) & (F.col("m") >= 2) & (F.col("r") <= F.col("k"))
    return df.select("session", "n", F.when(held, "val").otherwise("train").alias("split"))


def split_by_run(pairs: DataFrame, fraction: float = 0.15, step: int = STEP) -> DataFrame:
    """Adds ``split`` to each session's pairs: trailing runs are held out; of a single run the last pairs, with ``step`` pairs before them discarded."""
    per = pairs.groupBy("session", "run_id").agg(F.count("*").alias("n"))
    s = Window.partitionBy("session")
    w = s.orderBy(F.col("run_id").desc())
    per = per.withColumn("cum", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(s)).withColumn("m", F.count("*").over(s)).withColumn("r", F.row_number().over(w))
    k = F.sum(F.when(F.col("cum") < F.bround(F.col("total") * fraction), 1).otherwise(0)).over(s) + 1
    per = per.withColumn("k", F.least(F.greatest(k, F.lit(1)), F.col("m") - 1)).select("session", "run_id", "total", "m", "r", "k")
    at = F.row_number().over(Window.partitionBy("session").orderBy(F.col("cycle_i").desc()))
    one = pairs.join(per, ["session", "run_id"]).withColumn("_at", F.when(F.col("m") == 1, at))
    n_val = F.greatest(F.lit(1), F.bround(F.col("total") * fraction))
    single = F.when(F.col("_at") <= n_val, "val").when(F.col("_at") <= n_val + step, "guard").otherwise("train")
    return one.withColumn("split", F.when(F.col("m") == 1, single).when(F.col("r") <= F.col("k"), "val").otherwise("train")).select(*pairs.columns, "split")


def action_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation (at least 1e-6) of each column; 0 and 1 of no rows."""
    out = []
    for c in columns:
        out += [F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(f"{c}_mean"), F.coalesce(F.greatest(F.stddev_pop(F.col(c).cast("double")), F.lit(1e-6)), F.lit(1.0)).alias(f"{c}_std")]
    return rows.agg(*out)


def sequence_gaps(frames: DataFrame, by: list[str], seq: str = "seq", order: str = "ord") -> DataFrame:
    """Gaps in sequence numbers: the number before, after, and how many are lost."""
    w = Window.partitionBy(*by).orderBy(order)
    return frames.withColumn("before", F.lag(seq).over(w)).where(F.col(seq) - F.col("before") > 1).select(*by, "before", F.col(seq).alias("after"), (F.col(seq) - F.col("before") - 1).alias("lost"))


def packet_offsets(frames: DataFrame, by: list[str], length: str = "length", size: str = "size", order: str = "ord") -> DataFrame:
    """Adds each packet's byte ``offset``; packets from the first that does not fit in its file on are left out."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    at = frames.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)))
    return at.where(F.col("offset") + F.col(length) <= F.col(size))


def compacted(rows: DataFrame, by: list[str], found: Column, order: str) -> DataFrame:
    """Adds ``position``: the dense place, from 0, among rows that were found; -1 for the others."""
    w = Window.partitionBy(*by, F.col("_found")).orderBy(order)
    return rows.withColumn("_found", found).withColumn("position", F.when(F.col("_found"), F.row_number().over(w) - 1).otherwise(-1).cast("long")).drop("_found")
