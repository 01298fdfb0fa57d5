"""Queries over the test tables for each operator of the library, and SQL that says the same.

Events stand for telemetry: user_id is the session, event_id the write order, ts in microseconds the tick, and cycle ids count
1 to 20 again and again within a session. Tolerances are hours, as events are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import asof as A
from .operators import cycles as C
from .operators import frames as R
from .operators import latents as L

HOUR = 3_600_000_000
_NUM = "row_number() OVER (PARTITION BY user_id ORDER BY event_id)"
EV = f"""WITH ev AS (SELECT user_id AS session, event_id AS ord, epoch_us(ts) AS tick, event_type, value,
  (({_NUM} - 1) % 20 + 1)::BIGINT AS cycle_id,
  CASE event_type WHEN 'error' THEN 'skipped_no_data' WHEN 'signup' THEN 'floating' ELSE 'planned' END AS outcome,
  CASE WHEN value < 5 THEN 'floating' ELSE 'navigating' END AS status FROM events)"""
RUNS = EV + """, ru AS (SELECT *, sum(CASE WHEN cycle_id <= prev THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ord)::BIGINT AS run_id
  FROM (SELECT *, lag(cycle_id) OVER (PARTITION BY session ORDER BY ord) AS prev FROM ev))"""
BOUNDS = RUNS + ", bo AS (SELECT session, run_id, min(tick) AS t_start, max(tick) AS t_end, count(*) AS n FROM ru GROUP BY ALL)"
LABELS = RUNS + f""", ve AS (
  SELECT c.session, c.ord, b.tick AS bt, b.ord AS bo, f.tick AS ft, f.ord AS fo FROM ru c
  ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type IN ('error', 'purchase') AND value < 120) b ON c.session = b.session AND c.tick > b.tick
  ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type IN ('error', 'purchase') AND value < 120) f ON c.session = f.session AND c.tick <= f.tick
), vx AS (
  SELECT v.session, v.ord, e.event_type = 'error' AND abs(e.tick - r.tick) <= {HOUR} AS vetoed FROM ve v JOIN ru r USING (session, ord)
  JOIN ev e ON e.session = v.session AND e.ord = CASE WHEN ft IS NULL THEN bo WHEN bt IS NULL THEN fo WHEN r.tick - bt <= ft - r.tick THEN bo ELSE fo END
), la AS (
  SELECT ru.*, CASE WHEN value BETWEEN 100 AND 110 THEN 'udp_drop' WHEN value BETWEEN 200 AND 240 OR outcome LIKE 'skipped%' THEN 'no_command' WHEN outcome <> 'planned' THEN 'untrainable_outcome'
    WHEN status <> 'navigating' THEN 'untrainable_status' WHEN coalesce(vetoed, false) THEN 'vetoed' END AS drop_reason
  FROM ru LEFT JOIN vx USING (session, ord))"""
KEPT = LABELS + ", ke AS (SELECT session, run_id, cycle_id, tick, value FROM la WHERE drop_reason IS NULL)"
PAIRS = KEPT + f""", pa AS (SELECT session, run_id, cycle_id AS cycle_i, c2 AS cycle_j, tick AS tick_i, t2 AS tick_j, value FROM (
  SELECT *, lead(run_id, 2) OVER w AS r2, lead(cycle_id, 2) OVER w AS c2, lead(tick, 2) OVER w AS t2 FROM ke WINDOW w AS (PARTITION BY session ORDER BY run_id, cycle_id))
  WHERE r2 = run_id AND c2 - cycle_id = 2 AND abs(t2 - tick - 2 * {7 * HOUR}) <= {10 * HOUR})"""
CLICKS = EV + ", cl AS (SELECT session, ord, tick AS ts FROM ev WHERE event_type = 'click'), vi AS (SELECT session, ord, tick AS ts FROM ev WHERE event_type = 'view')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    tick = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    df = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("ord"), tick.alias("tick"), "event_type", "value", "props")
    n = F.row_number().over(Window.partitionBy("session").orderBy("ord"))
    outcome = F.when(F.col("event_type") == "error", "skipped_no_data").when(F.col("event_type") == "signup", "floating").otherwise("planned")
    return df.withColumns({"cycle_id": ((n - 1) % 20 + 1).cast("long"), "outcome": outcome, "status": F.when(F.col("value") < 5, "floating").otherwise("navigating")})


def labelled(spark: SparkSession, d: str) -> DataFrame:
    ev = events(spark, d).drop("props")
    commands = ev.where("value NOT BETWEEN 200 AND 240 AND outcome NOT LIKE 'skipped%'").select("session", "ord", "tick", "cycle_id", F.col("value").alias("linear"), F.col("value").alias("angular"))
    source = F.when(F.col("event_type") == "error", "protective_stop").otherwise("motor_target")
    executed = ev.where("event_type IN ('error', 'purchase') AND value < 120").select("session", "ord", "tick", source.alias("source"))
    return C.label_drops(ev, ev.where("value NOT BETWEEN 100 AND 110").select("session", "ord", "tick", "cycle_id"), commands, executed, veto_us=HOUR)


def kept(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).where("drop_reason IS NULL")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return C.step_pairs(kept(spark, d), 2, 7 * HOUR, 10 * HOUR)


def clicks_views(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ev = events(spark, d).withColumnRenamed("tick", "ts").select("session", "ord", "ts", "event_type")
    return ev.where("event_type = 'click'").drop("event_type"), ev.where("event_type = 'view'").drop("event_type")


@query(KEPT + " SELECT * FROM ke")
def q1_cycle_table(spark, d):
    return kept(spark, d).select("session", "run_id", "cycle_id", "tick", "value")


@query(LABELS + " SELECT r AS drop_reason, count(drop_reason) AS n FROM unnest(['udp_drop','no_command','untrainable_outcome','untrainable_status','vetoed']) u(r) LEFT JOIN la ON drop_reason = r GROUP BY r")
def q2_drop_ledger(spark, d):
    return C.drop_ledger(labelled(spark, d))


@query(RUNS + " SELECT session, ord, cycle_id, run_id FROM ru")
def q3_runs(spark, d):
    return C.segment_runs(events(spark, d)).select("session", "ord", "cycle_id", "run_id")


@query(BOUNDS + " SELECT * FROM bo")
def q4_run_bounds(spark, d):
    return C.run_bounds(C.segment_runs(events(spark, d)))


@query(BOUNDS + f" SELECT e.session, e.ord, coalesce(max(b.run_id), -1) AS run_id FROM ev e LEFT JOIN bo b ON e.session = b.session AND e.tick + {HOUR} BETWEEN t_start AND t_end GROUP BY ALL")
def q5_assign_run(spark, d):
    ev = events(spark, d)
    bounds = C.run_bounds(C.segment_runs(ev))
    return C.assign_run(ev.withColumn("tick", F.col("tick") + HOUR), bounds).select("session", "ord", "run_id")


@query(CLICKS + f" SELECT c.session, c.ord, coalesce(CASE WHEN c.ts - v.ts <= {24 * HOUR} THEN v.ord END, -1) AS m_ord FROM cl c ASOF LEFT JOIN vi v ON c.session = v.session AND c.ts >= v.ts")
def q6_asof_causal(spark, d):
    left, right = clicks_views(spark, d)
    return A.asof(left, right, ["session"], [], 24 * HOUR).select("session", "ord", A.none_as(F.col("m.ord")).alias("m_ord"))


@query(CLICKS + f" SELECT c.session, c.ord, coalesce(CASE WHEN v.ts - c.ts <= {24 * HOUR} THEN v.ord END, -1) AS m_ord FROM cl c ASOF LEFT JOIN vi v ON c.session = v.session AND c.ts <= v.ts")
def q7_asof_forward(spark, d):
    left, right = clicks_views(spark, d)
    return A.asof(left, right, ["session"], [], 24 * HOUR, "forward").select("session", "ord", A.none_as(F.col("m.ord")).alias("m_ord"))


@query(LABELS + " SELECT session, ord, coalesce(vetoed, false) AS vetoed FROM ru LEFT JOIN vx USING (session, ord)")
def q8_nearest_veto(spark, d):
    ev = events(spark, d)
    source = F.when(F.col("event_type") == "error", "protective_stop").otherwise("motor_target")
    executed = ev.where("event_type IN ('error', 'purchase') AND value < 120").select("session", "ord", "tick", source.alias("source"))
    return C.vetoed(ev, executed, HOUR).select("session", "ord", "vetoed")


@query(EV + " SELECT e.session, e.ord, coalesce(x.ord, -1) AS m_ord FROM ev e LEFT JOIN (SELECT * FROM ev WHERE event_type IN ('click', 'view')) x ON x.session = e.session AND x.tick = e.tick")
def q9_exact(spark, d):
    ev = events(spark, d).withColumnRenamed("tick", "ts").select("session", "ord", "ts", "event_type")
    return A.exact(ev, ev.where("event_type IN ('click', 'view')"), ["session"], []).select("session", "ord", A.none_as(F.col("m.ord")).alias("m_ord"))


@query(EV + ", f AS (SELECT session, tick + 3000 AS ts FROM ev WHERE event_type <> 'view'), q AS (SELECT e.session, f.ts - e.tick AS d FROM ev e ASOF JOIN f ON e.session = f.session AND e.tick <= f.ts) SELECT s.session, nullif(m, 0) AS offset_us FROM (SELECT DISTINCT session FROM q WHERE abs(d) <= 50000) s JOIN (SELECT session, mode(d ORDER BY d) AS m FROM q WHERE abs(d) <= 50000 GROUP BY session) USING (session)")
def q10_modal_offset(spark, d):
    ev = events(spark, d).select("session", "ord", F.col("tick").alias("ts"), "event_type")
    return A.modal_offset(ev, ev.where("event_type <> 'view'").withColumn("ts", F.col("ts") + 3000), ["session"], 50_000).select("session", F.col("offset").alias("offset_us"))


_SHIFT = "CASE WHEN session % 3 = 0 THEN 0 WHEN session % 3 = 1 THEN 3000 ELSE 0 END"


@query(EV + f""", f AS (SELECT session, ord, tick + {_SHIFT} AS ts FROM ev WHERE session % 3 <> 2 OR event_type IN ('click', 'error'))
SELECT e.session, e.tick AS capture_us, coalesce(CASE WHEN e.session % 3 = 2 THEN CASE WHEN e.tick - a.ts <= {24 * HOUR} THEN a.ord END ELSE e.ord END, -1) AS frame_ord,
  CASE e.session % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'constant_offset' ELSE 'approximate' END AS strategy
FROM ev e ASOF LEFT JOIN f a ON e.session = a.session AND e.tick >= a.ts""")
def q11_cascade(spark, d):
    ev = events(spark, d).select("session", "ord", F.col("tick").alias("ts"), "event_type")
    frames = ev.where("session % 3 <> 2 OR event_type IN ('click', 'error')").withColumn("ts", F.col("ts") + F.expr(_SHIFT))
    out = A.resolve_frames(ev.withColumnRenamed("ts", "capture_us"), frames, ["session"], 24 * HOUR)
    return out.select("session", "capture_us", A.none_as(F.col("frame_ord")).alias("frame_ord"), "strategy")


@query(EV + f", f AS (SELECT session, ord, tick AS ts, CASE WHEN event_type = 'view' THEN -1 ELSE cycle_id END AS seq FROM ev WHERE event_type IN ('click', 'view')), k AS (SELECT session, seq, max(ord) AS o FROM f WHERE seq >= 0 GROUP BY ALL) SELECT e.session, e.ord, coalesce(k.o, CASE WHEN e.tick - a.ts <= {24 * HOUR} THEN a.ord END, -1) AS m_ord FROM ev e ASOF LEFT JOIN f a ON e.session = a.session AND e.tick >= a.ts LEFT JOIN k ON k.session = e.session AND k.seq = e.cycle_id")
def q12_key_then_asof(spark, d):
    ev = events(spark, d).select("session", "ord", F.col("tick").alias("ts"), F.col("cycle_id").alias("seq"), "event_type")
    right = ev.where("event_type IN ('click', 'view')").withColumn("seq", F.when(F.col("event_type") == "view", F.lit(-1).cast("long")).otherwise(F.col("seq")))
    return A.key_then_asof(ev, right, ["session"], "seq", [], 24 * HOUR).select("session", "ord", A.none_as(F.col("m.ord")).alias("m_ord"))


@query(PAIRS + " SELECT session, run_id, cycle_i, cycle_j, tick_i, tick_j FROM pa")
def q13_pairs(spark, d):
    return pairs(spark, d)


@query(EV + " SELECT session, b AS before, cycle_id AS after, cycle_id - b - 1 AS lost FROM (SELECT *, lag(cycle_id) OVER (PARTITION BY session ORDER BY ord) AS b FROM ev WHERE value NOT BETWEEN 100 AND 110) WHERE cycle_id - b > 1")
def q14_sequence_gaps(spark, d):
    return C.sequence_gaps(events(spark, d).where("value NOT BETWEEN 100 AND 110"), ["session"], "cycle_id")


@query(PAIRS + ", c AS (SELECT session, count(*) AS n FROM pa GROUP BY session), x AS (SELECT *, sum(n) OVER (ORDER BY session DESC) AS cum, sum(n) OVER () AS total, count(*) OVER () AS m, row_number() OVER (ORDER BY session DESC) AS r FROM c), y AS (SELECT *, sum(CASE WHEN cum < round_even(total * 0.15, 0) THEN 1 ELSE 0 END) OVER () + 1 AS k FROM x) SELECT session, n, CASE WHEN m >= 2 AND r <= least(greatest(k, 1), m - 1) THEN 'val' ELSE 'train' END AS split FROM y")
def q15_split_session(spark, d):
    return C.split_by_session(pairs(spark, d).groupBy("session").agg(F.count("*").alias("n")))


@query(PAIRS + """, p AS (SELECT session, run_id, count(*) AS n FROM pa GROUP BY ALL), x AS (SELECT *, sum(n) OVER (PARTITION BY session ORDER BY run_id DESC) AS cum, sum(n) OVER (PARTITION BY session) AS total, count(*) OVER (PARTITION BY session) AS m, row_number() OVER (PARTITION BY session ORDER BY run_id DESC) AS r FROM p),
y AS (SELECT *, sum(CASE WHEN cum < round_even(total * 0.15, 0) THEN 1 ELSE 0 END) OVER (PARTITION BY session) + 1 AS k FROM x), z AS (SELECT pa.*, total, m, r, k, row_number() OVER (PARTITION BY pa.session ORDER BY cycle_i DESC) AS a FROM pa JOIN y USING (session, run_id))
SELECT session, run_id, cycle_i, CASE WHEN m > 1 THEN CASE WHEN r <= least(greatest(k, 1), m - 1) THEN 'val' ELSE 'train' END WHEN a <= greatest(1, round_even(total * 0.15, 0)) THEN 'val' WHEN a <= greatest(1, round_even(total * 0.15, 0)) + 2 THEN 'guard' ELSE 'train' END AS split FROM z""")
def q16_split_run(spark, d):
    return C.split_by_run(pairs(spark, d)).select("session", "run_id", "cycle_i", "split")


@query(KEPT + " SELECT round(avg(value), 6) AS value_mean, round(greatest(stddev_pop(value), 1e-6), 6) AS value_std FROM ke")
def q17_train_stats(spark, d):
    out = C.action_stats(kept(spark, d), ["value"])
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("SELECT o_orderkey AS session, coalesce(l.q, 0.0) AS v_linear, coalesce(l.t, 0.0) AS v_angular FROM orders LEFT JOIN (SELECT l_orderkey AS k, arg_min(l_quantity, row(l_linenumber, l_quantity, l_tax)) AS q, arg_min(l_tax, row(l_linenumber, l_quantity, l_tax)) AS t FROM lineitem WHERE l_linenumber > 1 GROUP BY 1) l ON k = o_orderkey")
def q18_proprio(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("session"), F.lit(0).alias("velocity_seq"))
    items = table(spark, d, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("session"), F.lit(0).alias("seq"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").alias("v_linear"), F.col("l_tax").alias("v_angular"))
    return C.with_proprio(orders, items).select("session", "v_linear", "v_angular")


@query("SELECT p_partkey, s AS step, greatest(1, 200 // s) AS threshold, CASE WHEN least(u, 1023) < greatest(1, 200 // s) THEN 0 ELSE least(least(u, 1023) * s, 65535) END AS mm FROM (SELECT p_partkey, p_size AS s, (p_partkey % 1100)::INT AS u FROM part)")
def q19_dequantise(spark, d):
    u, s = (F.col("p_partkey") % 1100).cast("int"), F.col("p_size")
    return table(spark, d, "part").select("p_partkey", s.alias("step"), S.invalid_threshold(s).alias("threshold"), S.dequantise_depth(u, s).alias("mm"))


@query("SELECT l_orderkey, l_linenumber, round((floor(l_extendedprice)::INT::FLOAT / 1000.0::FLOAT)::DOUBLE / 5.0, 6) AS depth, floor(l_extendedprice)::INT > 0 AS valid FROM lineitem")
def q20_depth_channels(spark, d):
    mm = F.floor("l_extendedprice").cast("int")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.depth_metres(mm).cast("double"), 6).alias("depth"), (mm > 0).alias("valid"))


_XY = "SELECT session, ord, (value / 30.0 - 8.0)::FLOAT AS x, ((ord % 997) / 60.0 - 8.0)::FLOAT AS y FROM ev"


def points(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("session", "ord", (F.col("value") / 30.0 - 8.0).cast("float").alias("x"), ((F.col("ord") % 997) / 60.0 - 8.0).cast("float").alias("y"))


@query(EV + f", p AS ({_XY}), c AS (SELECT session, floor((x + 6::FLOAT) / 0.1::FLOAT)::INT AS r, floor((y + 6::FLOAT) / 0.1::FLOAT)::INT AS c FROM p) SELECT DISTINCT session, r * 120 + c AS cell FROM c WHERE r BETWEEN 0 AND 119 AND c BETWEEN 0 AND 119")
def q21_bev_cells(spark, d):
    return R.occupied_cells(points(spark, d), ["session"]).select("session", F.explode("cells").alias("cell"))


@query(EV + f", p AS ({_XY}) SELECT session, ord, round((-x::DOUBLE - 0.448)::FLOAT::DOUBLE, 4) AS rx, round((-y::DOUBLE + 0.251)::FLOAT::DOUBLE, 4) AS ry FROM p")
def q22_lidar_transform(spark, d):
    x, y = S.to_robot(F.col("x"), F.col("y"), "lidar_back_left")
    return points(spark, d).select("session", "ord", F.round(x.cast("double"), 4).alias("rx"), F.round(y.cast("double"), 4).alias("ry"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS seq, 0::BIGINT AS frame_index FROM events WHERE props->>'$.k' IS NOT NULL")
def q23_sidecar_explode(spark, d):
    sidecar = F.concat(F.lit('{"frames": [{"timestamp_us": 1, "length": 2, "seq": '), F.get_json_object("props", "$.k"), F.lit("}]}"))
    meta = table(spark, d, "events").where("get_json_object(props, '$.k') IS NOT NULL").select("event_id", sidecar.alias("meta"))
    return R.sidecar_frames(meta, ["event_id"]).select("event_id", "seq", "frame_index")


@query('SELECT doc_id, "offset" FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source) AS total, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM documents) WHERE "offset" + n_chars < total')
def q37_packet_offsets_torn(spark, d):
    size = F.sum("n_chars").over(Window.partitionBy("source")) - 1
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars", size.alias("size"))
    return C.packet_offsets(docs, ["source"], "n_chars", "size", "doc_id").select("doc_id", "offset")


@query(EV + " SELECT session, ord, CASE WHEN event_type = 'error' THEN -1 ELSE row_number() OVER (PARTITION BY session, event_type = 'error' ORDER BY ord) - 1 END AS position FROM ev")
def q25_compaction(spark, d):
    return C.compacted(events(spark, d), ["session"], F.col("event_type") != "error", "ord").select("session", "ord", "position")


@query(EV + ", a AS (SELECT session, ord, row_number() OVER (PARTITION BY session ORDER BY ord) - 1 AS p, value FROM ev WHERE event_type <> 'error'), b AS (SELECT session, ord, row_number() OVER (PARTITION BY session ORDER BY ord) - 1 AS q FROM a WHERE value >= 100) SELECT e.session, e.ord, coalesce(q, -1) AS position FROM ev e LEFT JOIN b ON e.session = b.session AND e.ord = b.ord")
def q26_recompaction(spark, d):
    first = C.compacted(events(spark, d), ["session"], F.col("event_type") != "error", "ord")
    decoded = (F.col("position") >= 0) & (F.col("value") >= 100)
    again = C.compacted(first.withColumn("_d", decoded).drop("position"), ["session"], F.col("_d"), "ord")
    return again.select("session", "ord", "position")


@query("SELECT dim - 1 AS dim, round(stddev_samp(v), 5) AS std FROM (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(1, 65)) AS dim FROM embeddings) GROUP BY dim")
def q27_latent_std(spark, d):
    return L.latent_std(table(spark, d, "embeddings"), "embedding").select("dim", F.round("std", 5).alias("std"))


@query("WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(1, 65)) AS dim FROM embeddings) SELECT a.dim - 1 AS i, b.dim - 1 AS j, round(covar_samp(a.v, b.v), 5) + 0.0 AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.dim < b.dim GROUP BY ALL")
def q36_latent_cov_whole(spark, d):
    return L.latent_cov(table(spark, d, "embeddings"), "embedding", 0, 64).select("i", "j", (F.round("cov", 5) + 0.0).alias("cov"))


@query("SELECT round(avg(CASE WHEN abs(x - y) < 1 THEN 0.5 * (x - y) * (x - y) ELSE abs(x - y) - 0.5 END), 5) AS loss FROM (SELECT unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)")
def q29_smooth_l1(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("target"))
    return L.smooth_l1(e.join(nxt, "vec_id"), "embedding", "target").select(F.round("loss", 5).alias("loss"))


_ROLES = ", fr AS (SELECT session, ord, tick, unnest([{'role': 'depth', 'seq': -1::BIGINT, 'age': CASE WHEN ord % 11 = 0 THEN -1 ELSE ord * 1000 % 500000 END}, {'role': 'rgb', 'seq': cycle_id, 'age': ord * 777 % 400000}]) AS r FROM ev)"


def roles(spark: SparkSession, d: str) -> DataFrame:
    age = F.when(F.col("ord") % 11 == 0, F.lit(-1).cast("long")).otherwise(F.col("ord") * 1000 % 500000)
    wide = events(spark, d).select("session", "ord", "tick", age.alias("age_us.depth"), (F.col("ord") * 777 % 400000).alias("age_us.rgb"), F.col("cycle_id").alias("seq.rgb"))
    return C.unpivot_roles(wide, ["session", "ord"])


@query(EV + _ROLES + " SELECT session, ord, r.role AS role, r.age BETWEEN 0 AND 300000 AS present, CASE WHEN r.age BETWEEN 0 AND 300000 THEN tick - r.age ELSE -1 END AS capture_us FROM fr")
def q30_freshness_gate(spark, d):
    return roles(spark, d).select("session", "ord", "role", "present", "capture_us")


@query(EV + _ROLES + " SELECT session, ord, r.role AS role, r.seq AS seq, r.age AS age_us FROM fr")
def q31_unpivot_roles(spark, d):
    return roles(spark, d).select("session", "ord", "role", "seq", "age_us")


_CODEC = "CASE page_id % 6 WHEN 0 THEN 'H265' WHEN 1 THEN 'hevc' WHEN 2 THEN 'AVC1' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'FFV1' END"


@query(f"SELECT page_id, CASE WHEN e IN ('h265', 'hevc') THEN 'hevc' WHEN e IN ('h264', 'avc', 'avc1', '') THEN 'h264' ELSE e END AS codec FROM (SELECT page_id, lower(coalesce({_CODEC}, '')) AS e FROM pages)")
def q32_codec_name(spark, d):
    return table(spark, d, "pages").select("page_id", S.codec_name(F.expr(_CODEC)).alias("codec"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE doc_id END AS chunk_start FROM documents")
def q33_chunk_regex(spark, d):
    name = F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit("_12.csv"))).otherwise(F.concat("source", F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit(".csv")))
    return table(spark, d, "documents").select("doc_id", S.chunk_start(name).alias("chunk_start"))


@query("SELECT source, count(*) AS declared, sum(CASE WHEN gap > 1 THEN 1 ELSE 0 END)::BIGINT AS gaps, sum(CASE WHEN gap > 1 THEN gap - 1 ELSE 0 END)::BIGINT AS lost FROM (SELECT source, doc_id - lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS gap FROM documents) GROUP BY source")
def q34_group_loss(spark, d):
    frames = table(spark, d, "documents").select("source", F.col("doc_id").alias("ord"), F.col("doc_id").alias("seq"), F.col("n_chars").alias("length"))
    return R.group_report(frames, ["source"]).select("source", "declared", "gaps", "lost")


@query("SELECT count(DISTINCT ts) AS ticks, count(*) AS n FROM events")
def q35_distinct_ticks(spark, d):
    return table(spark, d, "events").agg(F.countDistinct("ts").alias("ticks"), F.count("*").alias("n"))


_MOUNTS = [(v, f) for v, frames in S.MOUNTS.items() for f in frames]
_MOUNT_SQL = " UNION ALL ".join(f"SELECT '{v}' AS version, '{f}' AS frame, {a!r}::DOUBLE AS a, {b!r}::DOUBLE AS b, {c!r}::DOUBLE AS c, {e!r}::DOUBLE AS e, {x!r}::DOUBLE AS tx, {y!r}::DOUBLE AS ty" for v, frames in S.MOUNTS.items() for f, (a, b, c, e, x, y) in frames.items())


@query(EV + f", p AS ({_XY}), m AS ({_MOUNT_SQL}) SELECT version, frame, count(*) AS n, round(sum((x::DOUBLE * a + y::DOUBLE * b + tx)::FLOAT::DOUBLE), 2) AS sx, round(sum((x::DOUBLE * c + y::DOUBLE * e + ty)::FLOAT::DOUBLE), 2) AS sy FROM p, m GROUP BY ALL")
def q38_lidar_mounts(spark, d):
    at = [(v, f, *S.to_robot(F.col("x"), F.col("y"), f, v)) for v, f in _MOUNTS]
    rows = points(spark, d).select(F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(f).alias("frame"), x.cast("double").alias("x"), y.cast("double").alias("y")) for v, f, x, y in at])).alias("m")).select("m.*")
    return rows.groupBy("version", "frame").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("sx"), F.round(F.sum("y"), 2).alias("sy"))


_GROUPS = """WITH f AS (SELECT source, doc_id, n_chars, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS prev FROM documents WHERE n_chars > 0),
z AS (SELECT source, sum(n_chars) - CASE WHEN source < 'source_1' THEN 1 ELSE 0 END AS actual FROM documents GROUP BY source),
r AS (SELECT f.source, count(*) AS declared, sum(n_chars)::BIGINT AS bytes, any_value(actual)::BIGINT AS bytes_actual, sum(CASE WHEN doc_id - prev > 1 THEN 1 ELSE 0 END)::BIGINT AS gaps, sum(CASE WHEN doc_id - prev > 1 THEN doc_id - prev - 1 ELSE 0 END)::BIGINT AS lost,
  min(CASE WHEN doc_id - prev > 1 THEN prev + 1 END) AS first_gap, sum(CASE WHEN n_chars > 4000 THEN 1 ELSE 0 END)::BIGINT AS undecodable FROM f JOIN z USING (source) GROUP BY f.source)"""


def group_losses(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames, those that a decoder gives nothing for, and the report: sources stand for groups, texts of over 4000 characters for broken packets."""
    docs = table(spark, d, "documents").select("source", F.col("doc_id").alias("ord"), F.col("doc_id").alias("seq"), F.col("doc_id").alias("frame_index"), F.col("n_chars").alias("length"))
    frames = docs.where("length > 0")
    sizes = docs.groupBy("source").agg((F.sum("length") - F.when(F.col("source") < "source_1", 1).otherwise(0)).alias("size"))
    bad = R.undecodable_packets(frames, frames.where("length <= 4000"), ["source"])
    return frames, bad, R.group_report(frames, ["source"], sizes, bad)


@query(_GROUPS + " SELECT source, declared, bytes, bytes_actual, gaps, lost, first_gap, undecodable, bytes <> bytes_actual AS truncated FROM r")
def q39_group_report(spark, d):
    return group_losses(spark, d)[2]


@query(_GROUPS + " SELECT count(*) AS groups, count_if(gaps > 0)::BIGINT AS with_gaps, sum(lost)::BIGINT AS lost, count_if(bytes <> bytes_actual)::BIGINT AS truncated, round(sum(lost + undecodable) / sum(declared + lost) * 100, 6) AS net_percent FROM r")
def q40_fleet_summary(spark, d):
    return R.fleet_summary(group_losses(spark, d)[2]).withColumn("net_percent", F.round("net_percent", 6))


@query(_GROUPS + " SELECT f.source, f.doc_id AS seq FROM f JOIN r USING (source) WHERE n_chars > 4000 AND f.doc_id >= first_gap")
def q41_loss_cascade(spark, d):
    _, bad, report = group_losses(spark, d)
    return R.cascade(bad, report, ["source"]).select("source", "seq")


@query(EV + f""", p AS (SELECT session, cycle_id, x, y, event_type FROM ({_XY.replace("ord,", "ord, cycle_id, event_type,")}) WHERE event_type <> 'error'),
c AS (SELECT DISTINCT session, cycle_id, floor((x + 6::FLOAT) / 0.1::FLOAT)::INT AS r, floor((y + 6::FLOAT) / 0.1::FLOAT)::INT AS c FROM p WHERE event_type <> 'view'),
k AS (SELECT session, cycle_id, count(*) AS n_cells, sum(r * 120 + c)::BIGINT AS sum_cells FROM c WHERE r BETWEEN 0 AND 119 AND c BETWEEN 0 AND 119 GROUP BY ALL)
SELECT e.session, e.cycle_id, coalesce(n_cells, 0)::INT AS n_cells, coalesce(sum_cells, 0) AS sum_cells, coalesce(v, false) AS valid FROM (SELECT DISTINCT session, cycle_id FROM ev) e
LEFT JOIN k USING (session, cycle_id) LEFT JOIN (SELECT DISTINCT session, cycle_id, true AS v FROM p) USING (session, cycle_id)""")
def q42_bev(spark, d):
    ev = events(spark, d).select("session", "cycle_id", "ord", "event_type")
    point = F.array(F.struct("x", "y"))
    scans = ev.join(points(spark, d), ["session", "ord"]).where("event_type <> 'error'")
    scans = scans.withColumn("points", F.when(F.col("event_type") == "view", F.slice(point, 1, 0)).otherwise(point))  # a scan without a point is valid
    out = R.bev(ev.select("session", "cycle_id").distinct(), scans, ["session", "cycle_id"])
    return out.select("session", "cycle_id", F.size("cells").alias("n_cells"), F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_cells"), "valid")


@query(EV + f""", f AS (SELECT session, ord, tick AS ts, event_type FROM ev WHERE event_type IN ('click', 'error')),
w AS (SELECT session, ord, tick - 1000 AS capture_us FROM ev WHERE event_type <> 'signup'),
a AS (SELECT w.session, w.ord, capture_us, CASE WHEN capture_us - f.ts <= {24 * HOUR} THEN f.ord END AS fo, CASE WHEN capture_us - f.ts <= {24 * HOUR} THEN f.event_type = 'click' END AS ok FROM w ASOF LEFT JOIN f ON w.session = f.session AND capture_us >= f.ts),
u AS (SELECT session, capture_us, row_number() OVER (PARTITION BY session ORDER BY capture_us) - 1 AS position FROM (SELECT DISTINCT session, capture_us FROM a WHERE coalesce(ok, false)))
SELECT e.session, e.ord AS cycle_id, coalesce(position, -1) AS position FROM ev e LEFT JOIN a ON a.session = e.session AND a.ord = e.ord LEFT JOIN u ON u.session = a.session AND u.capture_us = a.capture_us""")
def q43_camera_index(spark, d):
    from .plans.store import camera_index

    ev = events(spark, d)
    kept = ev.select("session", F.lit(0).cast("long").alias("run_id"), F.col("ord").alias("cycle_id"))
    roles = ev.select("session", F.lit(0).cast("long").alias("run_id"), F.col("ord").alias("cycle_id"), (F.col("event_type") != "signup").alias("present"), (F.col("tick") - 1000).alias("capture_us"))
    frames = ev.where("event_type IN ('click', 'error')").select("session", F.col("tick").alias("ts"), "ord", (F.col("event_type") == "click").alias("decoded"))
    return camera_index(kept, roles, frames, 24 * HOUR)[0].select("session", "cycle_id", "position")


@query(EV + f""", f AS (SELECT session, tick AS ts FROM ev WHERE event_type = 'click') SELECT e.session, round(avg(CASE WHEN e.tick - f.ts <= {24 * HOUR} THEN 1.0 ELSE 0.0 END), 9) AS match_rate
FROM ev e ASOF LEFT JOIN f ON e.session = f.session AND e.tick >= f.ts GROUP BY e.session""")
def q44_match_rate(spark, d):
    ev = events(spark, d).select("session", "ord", F.col("tick").alias("ts"), "event_type")
    out = A.resolve_frames(ev.withColumnRenamed("ts", "capture_us"), ev.where("event_type = 'click'"), ["session"], 24 * HOUR)
    return out.groupBy("session").agg(F.round(F.first("match_rate"), 9).alias("match_rate"))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) AS l_quantity FROM lineitem, (SELECT avg(l_quantity) AS m, greatest(stddev_pop(l_quantity), 1e-6) AS s FROM lineitem)")
def q45_normalised(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return C.normalised(rows, C.action_stats(rows, ["l_quantity"]), ["l_quantity"]).withColumn("l_quantity", F.round("l_quantity", 6))


@query("SELECT p_partkey, CASE WHEN mm > 300 * s THEN 300 + greatest(4, 300 // 8) ELSE round_even(mm / s, 0)::INT END::INT AS units FROM (SELECT p_partkey, p_size AS s, (p_retailprice * 7)::INT AS mm FROM part)")
def q46_quantise(spark, d):
    mm = F.bround(F.col("p_retailprice") * 7).cast("int")
    return table(spark, d, "part").select("p_partkey", S.quantise_depth(mm, F.col("p_size"), F.lit(300)).alias("units"))
