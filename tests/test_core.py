import json
import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import scalars as S
from tickloom.operators import asof as A
from tickloom.operators import cycles as C
from tickloom.operators import frames as R
from tickloom.operators import latents as L
from tickloom.plans import store as P
from tickloom.sources import topics


def test_runs_restart_and_gap(spark):
    df = spark.createDataFrame([("a", k, c) for k, c in enumerate([48, 49, 3, 4, 5])] + [("b", k, c) for k, c in enumerate([1, 2, 3, 50, 51])], "session string, ord long, cycle_id long")
    got = {(r.session, r.ord): r.run_id for r in C.segment_runs(df.repartition(3)).collect()}
    assert [got["a", k] for k in range(5)] == [0, 0, 1, 1, 1] and [got["b", k] for k in range(5)] == [0] * 5


def test_bounds_and_assignment(spark):
    df = spark.createDataFrame([("a", r, t) for r, t in ((0, 100), (0, 200), (0, 300), (1, 1000), (1, 1100))], "session string, run_id long, tick long")
    q = spark.createDataFrame([("a", 0, 150), ("a", 1, 1050), ("a", 2, 5000)], "session string, ord long, tick long")
    assert [r.run_id for r in C.assign_run(q, C.run_bounds(df)).orderBy("ord").collect()] == [0, 1, -1]


def test_assignment_to_overlapping_runs(spark):
    rng = random.Random(8)
    bounds = [(s, r, a := rng.randrange(60), a + rng.randrange(12), 1) for s in range(12) for r in range(rng.randrange(9))]
    rows = [(s, k, k - 3) for s in range(13) for k in range(80)]
    got = C.assign_run(spark.createDataFrame(rows, "session long, ord long, tick long"), spark.createDataFrame(bounds, "session long, run_id long, t_start long, t_end long, n long")).collect()
    want = {(s, k): max((r for z, r, a, b, _ in bounds if z == s and a <= t <= b), default=-1) for s, k, t in rows}
    assert {(r.session, r.ord): r.run_id for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("span", [A.SPAN, 1])
def test_joins_against_brute_force(spark, monkeypatch, span):
    monkeypatch.setattr(A, "SPAN", span)
    rng = random.Random(5)
    right = [(s, rng.randrange(30), k) for s in range(20) for k in range(rng.randrange(9))]
    left = [(s, rng.randrange(-2, 33), k) for s in range(21) for k in range(8)]
    r = spark.createDataFrame(right, "s long, ts long, ord long").repartition(5)
    q = spark.createDataFrame(left, "s long, ts long, ord long").repartition(3)
    back = {(x.s, x.ord): x.m and x.m.ord for x in A.asof(q, r, ["s"], [], 5).collect()}
    ahead = {(x.s, x.ord): x.m and x.m.ord for x in A.asof(q, r, ["s"], [], 5, "forward").collect()}
    near = {(x.s, x.ord): x.m and x.m.ts for x in A.nearest(q, r, ["s"], [], 5).collect()}
    same = {(x.s, x.ord): x.m and x.m.ord for x in A.exact(q, r, ["s"], []).collect()}
    for s, t, k in left:
        own = [(a, o) for z, a, o in right if z == s]
        b, f = max((x for x in own if x[0] <= t), default=None), min((x for x in own if x[0] >= t), default=None)
        assert back[s, k] == (b[1] if b and t - b[0] <= 5 else None)
        assert ahead[s, k] == (f[1] if f and f[0] - t <= 5 else None)
        best = min((abs(a - t) for a, _ in own), default=9)
        if f or len({a for a, _ in own}) == len(own):
            assert (near[s, k] is None) == (best > 5) and (near[s, k] is None or abs(near[s, k] - t) == best)
        assert same[s, k] == min((o for a, o in own if a == t), default=None)
    offsets = {}
    for s, t, _ in left:
        own = sorted(a for z, a, _ in right if z == s)
        if own:
            d = next((a for a in own if a >= t), own[-1]) - t
            if abs(d) <= 5:
                offsets.setdefault(s, []).append(d)
    got = {x.s: x.offset for x in A.modal_offset(q, r, ["s"], 5).collect()}
    assert got == {s: min((-d.count(x), x) for x in d)[1] or None for s, d in offsets.items()}


def test_forward_is_as_fast_as_backward_for_one_key(spark):
    import time

    rows = spark.range(40_000).selectExpr("0 AS s", "id * 7 AS ts", "id AS ord").cache()
    rows.count()
    took = {}
    for direction in ("backward", "forward", "backward", "forward"):
        at = time.perf_counter()
        A.asof(rows, rows.where("ord % 3 = 0"), ["s"], [], None, direction).write.format("noop").mode("overwrite").save()
        took[direction] = time.perf_counter() - at
    assert took["forward"] < 3 * took["backward"] + 1


def test_cascade_strategies(spark):
    frames = spark.createDataFrame([("e", t, k) for k, t in enumerate([0, 100, 200, 300])] + [("o", t + 3, k) for k, t in enumerate([0, 100, 200])] + [("a", t, k) for k, t in enumerate([0, 47, 103, 251])], "s string, ts long, ord long")
    want = spark.createDataFrame([("e", 100), ("e", 300), ("e", 0), ("o", 0), ("o", 100), ("o", 200), ("a", 50), ("a", -1), ("n", 7)], "s string, capture_us long")
    got = {(r.s, r.capture_us): (r.frame_ord, r.strategy, r.offset_us, r.match_rate) for r in A.resolve_frames(want, frames, ["s"], 50).collect()}
    assert got["e", 300] == (3, "exact", None, 1.0) and got["o", 200] == (2, "constant_offset", 3, 1.0)
    assert got["a", 50] == (1, "approximate", None, 1.0) and got["a", -1][0] is None and got["n", 7] == (None, "approximate", None, 0.0)


def test_drop_precedence_and_errors(spark):
    cyc = [("s", k, k * 100_000, k, "planned" if k != 4 else "skipped", "navigating" if k != 5 else "floating") for k in range(1, 7)]
    c = spark.createDataFrame(cyc, "session string, ord long, tick long, cycle_id long, outcome string, status string")
    f = c.where("cycle_id <> 3").select("session", "ord", "tick", "cycle_id")
    cmd = c.where("cycle_id <> 4").select("session", "ord", "tick", "cycle_id", F.lit(1.0).alias("linear"), F.lit(0.0).alias("angular"))
    ex = spark.createDataFrame([("s", 0, 200_000, "protective_stop"), ("s", 1, 600_000, "hold")], "session string, ord long, tick long, source string")
    out = C.label_drops(c, f, cmd, ex, veto_us=10_000)
    assert {r.cycle_id: r.drop_reason for r in out.collect()} == {1: None, 2: "vetoed", 3: "udp_drop", 4: "no_command", 5: "untrainable_status", 6: None}
    assert {r.drop_reason: r.n for r in C.drop_ledger(out).collect()} == {"vetoed": 1, "udp_drop": 1, "no_command": 1, "untrainable_status": 1, "untrainable_outcome": 0}
    with pytest.raises(ValueError):
        C.label_drops(c, f.drop("cycle_id"), cmd)
    for a, b in ((c, f.union(f)), (c.union(c.withColumn("cycle_id", F.lit(None).cast("long"))).union(c.withColumn("cycle_id", F.lit(None).cast("long"))), f)):
        with pytest.raises(Exception, match="duplicate session, run_id, cycle_id"):
            C.label_drops(a, b, cmd).where("drop_reason IS NULL").count()
    for a, b in ((c.limit(0), f), (c, f.limit(0))):
        with pytest.raises(ValueError, match="instrumentation"):
            C.label_drops(a, b, cmd)


def test_pairs_need_the_middle_row(spark):
    df = spark.createDataFrame([("s", 0, c, c * 100_000) for c in (1, 2, 3, 4, 6, 7)], "session string, run_id long, cycle_id long, tick long")
    assert [(r.cycle_i, r.cycle_j) for r in C.step_pairs(df).collect()] == [(1, 3), (2, 4)]


def test_splits(spark):
    c = spark.createDataFrame([(f"s{k}", 20) for k in range(5)], "session string, n long")
    assert [r.split for r in C.split_by_session(c).orderBy("session").collect()] == ["train"] * 4 + ["val"]
    p = spark.createDataFrame([("s", 0, k) for k in range(100)], "session string, run_id long, cycle_i long")
    got = [r.split for r in C.split_by_run(p).orderBy("cycle_i").collect()]
    assert got == ["train"] * 83 + ["guard"] * 2 + ["val"] * 15


def test_depth(spark):
    for step, least in ((16, 12), (8, 25), (1000, 1)):
        plane = np.array([0, least - 1, least, 1023, 2000], np.uint16)
        mm = R.dequantise_plane(plane, step)
        col = spark.createDataFrame([(int(u),) for u in plane], "u int").select(S.dequantise_depth(F.col("u"), F.lit(step)).alias("m")).collect()
        assert mm.tolist() == [r.m for r in col] == [0, 0, least * step, min(1023 * step, 65535), min(1023 * step, 65535)]
    with pytest.raises(TypeError):
        R.dequantise_plane(np.zeros(2, np.int32), 8)


def test_lidar_dropouts_and_versions(spark):
    s = spark.createDataFrame([("lidar_front_left", "0,1,0,0", "0,0,0,2")], "frame_id string, x string, y string")
    a, b = (R.lidar_points(s, v).first().points for v in ("v3", "v4"))
    assert len(a) == len(b) == 2 and abs(b[0].x - 1.452) < 1e-6 and abs(a[0].x - b[0].x) > 0.1
    with pytest.raises(ValueError):
        R.lidar_points(s, "v9")


def test_decoding_once_with_a_torn_packet(spark):
    groups = spark.createDataFrame([("g", bytearray(b"aabbc"))], "bin_path string, content binary")
    frames = spark.createDataFrame([("g", 0, 2, True), ("g", 1, 2, False), ("g", 2, 2, True)], "bin_path string, frame_index long, length long, wanted boolean")
    out = R.decode_groups(groups, frames, ["bin_path"], lambda blobs, _: [np.frombuffer(x, np.uint8) for x in blobs]).collect()
    assert [(r.frame_index, bytes(r.pixels)) for r in out] == [(0, b"aa")]


def test_covariance_of_every_pair_of_dimensions(spark):
    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    v = np.array([r.embedding for r in spark.read.parquet(f"{d}/embeddings.parquet").select("embedding").collect()], np.float64)
    got = {(r.i, r.j): r.cov for r in e.queries()["q36_latent_cov_whole"](spark, d).collect()}
    want = np.cov(v.T)
    assert len(got) == 64 * 63 // 2 and all(abs(want[k] - x) < 1e-5 for k, x in got.items())


def test_covariance_with_gaps_and_far_means(spark):
    rng = random.Random(2)
    rows = [[None if rng.random() < 0.2 else 1e7 + k * rng.random() for k in range(1, 5)][: rng.choice([2, 4])] for _ in range(90)]
    df = spark.createDataFrame([(r,) for r in [*rows, None]], "v array<double>").repartition(5)
    got = {(r.i, r.j): r["cov"] for r in L.latent_cov(df, "v", 1, 4).collect()}
    assert set(got) == {(1, 2), (1, 3), (2, 3)}
    for (i, j), x in got.items():
        both = [(r[i], r[j]) for r in rows if len(r) > j and r[i] is not None and r[j] is not None]
        assert x == pytest.approx(np.cov(np.array(both).T)[0, 1], rel=1e-6)


def test_loss_report_from_end_to_end(spark):
    data = {"a": [(10, b"aa"), (11, b"bb"), (14, b"x!"), (15, b"y!")], "b": [(1, b"cc"), (2, b"d!")], "c": [(1, b"ee"), (2, b"ff")], "no file": [(1, b"gg")]}
    frames = spark.createDataFrame([(g, k, k, q, len(x), True) for g, rows in data.items() for k, (q, x) in enumerate(rows)], "bin_path string, frame_index long, ord long, seq long, length long, wanted boolean")
    groups = spark.createDataFrame([(g, bytearray(b"".join(x for _, x in data[g])[: 3 if g == "c" else None])) for g in "abc"], "bin_path string, content binary")
    by = ["bin_path"]
    sizes = groups.select("bin_path", F.length("content").cast("long").alias("size"))
    frames = frames.join(groups.select("bin_path"), by)
    decoded = R.decode_groups(groups, frames, by, lambda blobs, _: [None if x.endswith(b"!") or len(x) < 2 else np.frombuffer(x, np.uint8) for x in blobs], stop_at_torn=False)
    bad = R.undecodable_packets(frames, decoded, by)
    report = R.group_report(frames, by, sizes, bad)
    got = {r.bin_path: (r.declared, r.bytes, r.bytes_actual, r.gaps, r.lost, r.truncated, r.undecodable) for r in report.collect()}
    assert got == {"a": (4, 8, 8, 1, 2, False, 2), "b": (2, 4, 4, 0, 0, False, 1), "c": (2, 4, 3, 0, 0, True, 1)}
    total = R.fleet_summary(report).first()
    assert (total.groups, total.with_gaps, total["lost"], total.truncated) == (3, 1, 2, 1) and total.net_percent == pytest.approx(60.0)
    assert sorted((r.bin_path, r.seq) for r in R.cascade(bad, report, by).collect()) == [("a", 14), ("a", 15)]


def test_only_the_tail_of_a_torn_file_is_left_out(spark):
    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    want, groups = {}, {}
    for r in sorted(spark.read.parquet(f"{d}/documents.parquet").select("source", "doc_id", "n_chars").collect(), key=lambda r: r.doc_id):
        groups.setdefault(r.source, []).append((r.doc_id, r.n_chars))
    for rows in groups.values():
        at = 0
        for i, n in rows:
            if at + n < sum(x for _, x in rows):
                want[i] = at
            at += n
    got = {r.doc_id: r.offset for r in e.queries()["q37_packet_offsets_torn"](spark, d).collect()}
    assert got == want and len(got) >= sum(len(rows) - 1 for rows in groups.values()) - 1


def test_topics(spark, tmp_path):
    d = tmp_path / "s1/data/navigation/planning_cycle"
    d.mkdir(parents=True)
    for t, rows in (("2", "3;NA\n"), ("1", "1;\n2;x\n")):
        (d / f"navigation_planning_cycle_{t.zfill(20)}.csv").write_text("cycle_id;status\n" + rows)
    root = f"file://{tmp_path}"
    assert [x.rsplit("/", 1)[1] for x in topics.find_sessions(spark, root)] == ["s1"]
    schema = T.StructType([T.StructField("cycle_id", T.LongType()), T.StructField("status", T.StringType())])
    got = topics.read_topic(spark, f"{root}/s1", topics.PLANNING, schema).orderBy("ord").collect()
    assert [(r.cycle_id, r.status) for r in got] == [(1, ""), (2, "x"), (3, "NA")]
    assert topics.read_topic(spark, f"{root}/s1", topics.COMMAND, schema).count() == 0
    names = [r.file_name for r in topics.read_topic(spark, f"{root}/s1", topics.PLANNING, schema).orderBy("ord").collect()]
    assert names == sorted(names) and len(set(names)) == 2
    odd = d / f"navigation_planning_cycle_{'9'.zfill(20)}.csv"
    odd.write_text('cycle_id;note;status\n4;"a;b";y\nNA;;z\n')  # a quoted separator, and a cell that is no number
    got = topics.read_topic(spark, f"{root}/s1", topics.PLANNING, schema).orderBy("ord").collect()
    assert [(r.cycle_id, r.note, r.status) for r in got[3:]] == [(4, "a;b", "y"), (None, "", "z")] and got[0].note is None
    for row in ("1;2;3", "1", '1;"2;3"', '"1";2;3'):
        odd.write_text(f"cycle_id;status\n{row}\n")
        bad = topics.read_topic(spark, f"{root}/s1", topics.PLANNING, schema)
        if row != '1;"2;3"':
            for query in (bad.select("status"), bad.select(F.lit(1)), bad.groupBy().count()):
                with pytest.raises(Exception, match="2 fields"):
                    query.collect()
        else:
            assert bad.where("chunk_start = 9").first().status == "2;3"
    odd.write_text("")
    with pytest.raises(ValueError, match="empty chunk"):
        topics.read_topic(spark, f"{root}/s1", topics.PLANNING, schema)


def write_session(root, name="s1", ticks=4, drop=()):
    """A recording of some ticks with two cameras and a lidar role."""
    d = root / name / "data"

    def topic(path, header, rows):
        (d / path).mkdir(parents=True, exist_ok=True)
        (d / path / f"{path.replace('/', '_')}_{'5'.zfill(20)}.csv").write_text("\n".join([header, *rows]) + "\n")

    at = [1_000_000 + 100_000 * k for k in range(ticks)]
    topic("navigation/planning_cycle", "timestamp_us;cycle_id;velocity_timestamp_us;velocity_seq;outcome;status", [f"{t};{k};{t};{k};planned;navigating" for k, t in enumerate(at)])
    roles = ("rgb_front", "depth_front", "lidar_front_left_front")
    header = "timestamp_us;cycle_id;provenance;" + ";".join(f"seq.{r};age_us.{r}" for r in roles)
    topic("navigation/sensor_frontier", header, [f"{t};{k};observed;" + ";".join(f"{k};20000" for _ in roles) for k, t in enumerate(at) if k not in drop])
    topic("navigation/command", "timestamp_us;cycle_id;navigation_status;desired_linear_velocity;desired_angular_velocity", [f"{t};{k};navigating;{k + 0.5};{-k}" for k, t in enumerate(at)])
    topic("ll_executed_command", "timestamp_us;source", [f"{t};motor_target" for t in at])
    topic("robot/velocity_estimate", "timestamp_us;seq;frame_id;linear_velocity;angular_velocity", [f"{t};{k};b;{k + 1}.5,0,0;0,0,{k}.25" for k, t in enumerate(at)])
    topic("lidar2d_front_left_front/points", "timestamp_us;seq;frame_id;x;y;z", [f"{t - 20000};{k};lidar_front_left;0,1,{k};0,0.5,1;0,0,0" for k, t in enumerate(at)])
    for folder, more in (("camera_oakd_front_rgb/image_encoded", {"encoding": "h265", "width": 64, "height": 64}), ("camera_oakd_front_mono_l/depth_image", {"width": 32, "height": 32, "horizon_m": 5.0, "step_mm": 16})):
        (d / folder).mkdir(parents=True)
        meta = more | {"frames": [{"timestamp_us": t - 20000, "seq": k, "length": 2} for k, t in enumerate(at)]}
        (d / folder / "g.meta.json").write_text(json.dumps(meta))
        (d / folder / "g.bin").write_bytes(b"".join(bytes([k, 100 + k]) for k in range(ticks)))
        (d / folder / "orphan.meta.json").write_text(json.dumps(meta))
        (d / folder / "broken.meta.json").write_text("{")
        (d / folder / "broken.bin").write_bytes(b"x")


def test_from_recordings_to_samples(spark, tmp_path, capsys):
    from tickloom.__main__ import main
    from tickloom.plans import chain

    def rgb_of(blobs, info):
        assert info["codec"] == "hevc"
        return [np.full((info["height"], info["width"], 3), b[1], np.uint8) for b in blobs]

    def depth_of(blobs, info):
        assert info["codec"] == "ffv1"
        return [np.full((info["height"], info["width"]), b[1], np.uint16) for b in blobs]

    write_session(tmp_path / "in", "s1")
    write_session(tmp_path / "in", "s2", 5, drop=(4,))
    root, store = f"file://{tmp_path}/in", f"file://{tmp_path}/store"
    sys.modules["fakes"] = type(sys)("fakes")
    sys.modules["fakes"].__dict__.update(rgb=rgb_of, depth=depth_of)
    main(["preprocess", "--sessions", root, "--out-root", store, "--rgb-decoder", "fakes:rgb", "--depth-decoder", "fakes:depth"], spark)
    assert "s1: 4 cycles" in capsys.readouterr().out
    m = P.read_manifest(spark, store, "s2")
    assert m["dropped"]["udp_drop"] == 1 and m["rgb_decode_rate"] == {"rgb_front": 1.0} and m["depth_join_strategy"] == {"depth_front": "exact"}
    assert list(m) == sorted(m) and m["lidar_match_rate"] == {"lidar_front_left_front": 1.0}
    whole = P.read_table(spark, store, "manifest")
    assert sorted(P.read_json_manifest(P.manifest_json(spark, store), whole).collect()) == sorted(whole.select(*whole.columns).collect())
    pairs = P.training_set(spark, store)
    assert sorted((r.session, r.cycle_i, r.cycle_j) for r in pairs.collect()) == [("s1", 0, 2), ("s1", 1, 3), ("s2", 0, 2), ("s2", 1, 3)]
    got = {(r.session, r.cycle_i): r for r in chain.samples(spark, store, pairs, ("rgb_front",), ("depth_front",)).collect()}
    r = got["s1", 1]
    rgb = np.frombuffer(r.rgb, "<f4").reshape(2, 1, 3, 190, 253)
    assert np.allclose(rgb[0], 101 / 255) and np.allclose(rgb[1], 103 / 255)
    depth = np.frombuffer(r.depth, "<f4").reshape(2, 1, 2, 100, 160)
    assert np.allclose(depth[1, 0, 0], 103 * 16 / 1000 / 5) and (depth[:, :, 1] == 1).all()
    grid = np.frombuffer(r.bev, "<f4").reshape(2, 1, 120, 120)
    want = np.zeros((120, 120))
    for x, y in ((1, 0.5), (1, 1)):
        want[int((np.float32(x + 0.448) + np.float32(6)) / np.float32(0.1)), int((np.float32(y + 0.251) + np.float32(6)) / np.float32(0.1))] = 1
    assert (grid[0, 0] == want).all() and len(got) == 4
    assert np.allclose(np.frombuffer(r.action, "<f4"), [1, -1]) and np.frombuffer(r.proprio, "<f4").tolist() == [2.5, 1.25, 4.5, 3.25]
    assert np.frombuffer(r.t_us, "<i8").tolist() == [1_100_000, 1_300_000]
    main(["diagnose", f"{root}/s1/data/camera_oakd_front_rgb/image_encoded", "--decoder", "fakes:rgb", "--verbose"], spark)
    assert "1 groups, 0 with gaps, 0 frames lost, 0 truncated" in capsys.readouterr().out
    for bad in (["preprocess"], ["preprocess", "--session", "a"], ["preprocess", "--session", "a", "--sessions", "b"]):
        with pytest.raises(SystemExit):
            main(bad, spark)


def test_names_of_roles_and_channels():
    assert topics.lidar_topic("lidar_front_left_front") == "lidar2d_front_left_front/points"
    assert topics.lidar_frame("lidar2d_back_right_right") == topics.lidar_frame("lidar_back_right_back") == "lidar_back_right"
    assert topics.lidar_roles_of("lidar_back_left") == ["lidar_back_left_left", "lidar_back_left_back"]
    assert (topics.rgb_role("oakd_front"), topics.depth_role("oakd_back")) == ("rgb_front", "depth_back")


def test_a_capture_after_its_tick_raises(spark):
    rows = spark.createDataFrame([("r", 10, 11, False), ("r", 10, 9, True)], "role string, tick long, capture_us long, present boolean")
    assert C.not_after_tick(rows).count() == 2
    with pytest.raises(Exception, match="after its own tick"):
        C.not_after_tick(rows.withColumn("present", F.lit(True))).collect()


def test_entry_without_the_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "tickloom", tmp_path / "tickloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import sys, __spark_entry__ as e; assert e.llm is None and set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()), *[m for m in sys.modules if 'llm' in m])"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, check=True)
    assert int(run.stdout) >= 44  # and no module of the subpackage


def test_store_keeps_missing_frames_out_of_pairs(spark, tmp_path):
    cyc = [(s, 0, k, k * 100_000, None if k < 12 else "no_command") for s in ("a", "b") for k in range(13)]
    labelled = spark.createDataFrame(cyc, "session string, run_id long, cycle_id long, tick long, drop_reason string")
    rows = [(s, r, k, k, k != 5 or r != "rgb_front", k * 100_000) for s, _, k, _, _ in cyc for r in ("rgb_front", "lidar_back_left_back")]
    roles = spark.createDataFrame([(s, 0, k, r, q, p, t if p else -1) for s, r, k, q, p, t in rows], "session string, run_id long, cycle_id long, role string, seq long, present boolean, capture_us long")
    frames = spark.createDataFrame([(s, k * 100_000, k, not (s == "b" and k == 7)) for s in "ab" for k in range(12)], "session string, ts long, ord long, decoded boolean")
    scans = spark.createDataFrame([(s, k * 100_000, k, k) for s in "ab" for k in range(12) if not (s == "a" and k == 9)], "session string, ts long, seq long, ord long")
    store = f"file://{tmp_path}/store"
    P.preprocess(labelled, store, roles, {"rgb_front": frames}, {"lidar_back_left_back": scans})
    got = {(r.session, r.cycle_i) for r in P.training_set(spark, store).collect()}
    gone = {"a": {5, 9}, "b": {5, 7}}
    assert got == {(s, i) for s in "ab" for i in range(10) if not {i, i + 2} & gone[s]}
    assert {r.split for r in P.training_set(spark, store).collect()} == {"train", "val"}
    assert {(r.session, r.cycle_i) for r in P.training_set(spark, store, cameras=[]).collect()} == {(s, i) for s in "ab" for i in range(10) if not (s == "a" and {i, i + 2} & {9})}
    assert P.training_set(spark, store, cameras=["rgb_back"]).count() == 0
    index = {(r.session, r.cycle_id): r.position for r in P.read_table(spark, store, "index").collect()}
    assert [index["b", k] for k in range(12)] == [0, 1, 2, 3, 4, -1, 5, -1, 6, 7, 8, 9]
    m = {r.session: r for r in P.read_table(spark, store, "manifest").collect()}
    assert m["a"].n_cycles == 12 and m["a"].dropped == {**dict.fromkeys(C.REASONS, 0), "no_command": 1} and m["b"].lidar_valid_rate == 1.0
    assert m["a"].lidar_match_rate["lidar_back_left_back"] == pytest.approx(11 / 12) and m["a"].lidar_roles_configured == ["lidar_back_left_back"]
    assert m["b"].rgb_join_strategy == {"rgb_front": "exact"} and m["b"].rgb_match_rate == {"rgb_front": 1.0} and m["b"].rgb_decode_rate["rgb_front"] == pytest.approx(10 / 11)
    assert m["a"].rgb_size == [253, 190] and m["a"].depth_cameras == [] and m["a"].depth_match_rate == {} and len(m["a"]) == 22


def test_store_without_lidar_gives_no_pairs(spark, tmp_path):
    labelled = spark.createDataFrame([("a", 0, k, k * 100_000, None) for k in range(6)], "session string, run_id long, cycle_id long, tick long, drop_reason string")
    P.preprocess(labelled, f"file://{tmp_path}/s")
    assert P.training_set(spark, f"file://{tmp_path}/s").count() == 0
    with pytest.raises(ValueError):
        P.preprocess(labelled, f"file://{tmp_path}/s", lidar={"lidar_back_left_back": labelled})


def test_injected_encoder_and_dynamics(spark):
    x = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    df = spark.createDataFrame([(k, bytearray(v.tobytes()), [float(k)] * 2) for k, v in enumerate(x)], "k long, t binary, a array<float>")
    out = L.encoded(df, "t", lambda b: b.sum(2), (3, 4))
    assert [r.z for r in out.orderBy("k").collect()] == x.sum(2).tolist()
    layers = [(np.ones((5, 5), np.float32) / 10, np.zeros(5, np.float32)), (np.ones((3, 5), np.float32), np.ones(3, np.float32))]
    for r in L.latent_step(out, "z", "a", layers).collect():
        h = np.r_[r.z, r.a] @ layers[0][0].T
        assert np.allclose(r.z_next, np.array(r.z) + (h / (1 + np.exp(-h))) @ layers[1][0].T + 1, rtol=1e-5)
    p = {r.block: r for r in L.variance_penalty(spark.createDataFrame([([0.0, 1.0, 5.0],), ([0.5, 1.0, -5.0],)], "z array<double>"), "z", [(0, 2), (2, 3)]).collect()}
    assert p[0].penalty == pytest.approx((1 - np.std([0, 0.5], ddof=1) + 1) / 2) and p[1].penalty == 0
    assert L.target_step([np.ones(2)], [np.zeros(2)], 0.9)[0].tolist() == [0.9, 0.9]


def test_resizing():
    image = np.arange(12, dtype=np.uint16).reshape(3, 4)
    assert R.resized(image, 4, 3, True) is image
    assert R.resized(image, 2, 3, False).tolist() == [[1, 3], [5, 7], [9, 11]]
    assert R.resized(np.array([[0, 100]], np.uint8), 4, 1, True).tolist() == [[0, 25, 75, 100]]
    assert R.rgb_channels(np.full((2, 3, 3), 255, np.uint8)).shape == (3, 2, 3) and R.dense_bev([121]).nonzero()[0].tolist() == [1]
