"""python -m tickloom preprocess --session DIR --out STORE | preprocess --sessions ROOT --out-root ROOT | diagnose CHANNEL.

Decoders are named as module:function (see operators.frames.Decoder); the library has no codecs of its own.
"""

from __future__ import annotations

import argparse
import sys
import time
from importlib import import_module

from pyspark.sql import SparkSession

from .functions.scalars import MOUNTS
from .operators.frames import fleet_summary
from .plans import chain
from .sources.topics import find_sessions


def _named(what: str | None):
    if what is None:
        return None
    module, _, name = what.partition(":")
    return getattr(import_module(module), name)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tickloom")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("preprocess", help="add recorded sessions to a store")
    p.add_argument("--session", help="one session's folder")
    p.add_argument("--sessions", help="a folder of sessions")
    p.add_argument("--out", help="the store, with --session")
    p.add_argument("--out-root", help="the store, with --sessions")
    p.add_argument("--sensor-version", default="v4_1", choices=sorted(MOUNTS))
    p.add_argument("--rgb-decoder", help="module:function")
    p.add_argument("--depth-decoder", help="module:function")
    d = commands.add_parser("diagnose", help="report the frames that a channel of recorded groups has lost")
    d.add_argument("channel", help="a folder of groups")
    d.add_argument("--decoder", help="module:function")
    d.add_argument("--verbose", action="store_true", help="a line for each group")
    got = parser.parse_args(args)
    if got.command == "preprocess":
        if bool(got.session) == bool(got.sessions):
            parser.error("give exactly one of --session and --sessions")
        if not (got.out if got.session else got.out_root):
            parser.error("--session needs --out, and --sessions needs --out-root")
    spark = spark or SparkSession.builder.appName("tickloom").getOrCreate()
    if got.command == "preprocess":
        store = got.out or got.out_root
        found = [got.session] if got.session else find_sessions(spark, got.sessions)
        if not found:
            parser.error(f"no session under {got.sessions} has planning cycles")
        for session in found:
            began = time.perf_counter()
            m = chain.preprocess_session(spark, session, store, _named(got.rgb_decoder), _named(got.depth_decoder), got.sensor_version)
            print(f"{session}: {m['n_cycles']} cycles in {time.perf_counter() - began:.1f} s, dropped {m['dropped']}")
            if not m["lidar_roles_configured"]:
                print(f"{session}: the frontier has no lidar role, so no pair can be made", file=sys.stderr)
        return
    report, cascades = chain.diagnose(spark, got.channel, _named(got.decoder))
    report = report.cache()
    if got.verbose:
        for r in report.orderBy("bin_path").toLocalIterator():
            print(f"{r.bin_path}: {r.declared} frames, {r.bytes} of {r.bytes_actual} bytes, {r['lost']} lost in {r.gaps} gaps, {r.undecodable} undecodable")
    total = fleet_summary(report).first()
    if not total.groups:
        print(f"no readable groups in {got.channel}", file=sys.stderr)
        sys.exit(1)
    print(f"{total.groups} groups, {total.with_gaps} with gaps, {total['lost']} frames lost, {total.truncated} truncated, {cascades.count()} undecodable after a gap; {total.net_percent:.1f}% unusable")


if __name__ == "__main__":
    main()
