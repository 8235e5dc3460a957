"""The command line: sketch, dist, three, triangle, info."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.params import SketchParams
from ..operators import distance
from ..operators.sketch import pooled_sketch, sketch
from ..sources.sequences import read_sequences
from ..sources.sketchfiles import write_sketch_files
from ..sources.store import BadSketch, read_sketches, resolve_inputs, shown
from . import reports

_LEAST = {"sketch": 1, "dist": 2, "three": 3, "triangle": 1, "info": 1}


class _Usage(Exception):
    pass


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        raise _Usage(message)


def parsers() -> dict[str, argparse.ArgumentParser]:
    """A parser per command; options and inputs may be mixed."""
    made = {name: _Parser(prog=f"kmerloom {name}") for name in _LEAST}
    make = made["sketch"]
    make.add_argument("-k", type=int, default=21, help="k-mer length, up to 42")
    make.add_argument("-s", default="1000", help="scale S (keeps one hash in S) or a share N/M")
    make.add_argument("-e", default=None, help="hash seed; odd seeds are raised by one")
    make.add_argument("-p", type=int, default=1, help="accepted for old scripts; Spark decides the parallelism")
    make.add_argument("-r", action="store_true", help="pool all inputs into one sketch")
    make.add_argument("-m", type=int, default=None, help="least count of a k-mer (default 2 with -r, else off)")
    make.add_argument("-o", default=None, help="folder for the sketch files (default: beside each input)")
    for name in ("dist", "three", "triangle"):
        made[name].add_argument("-j", action="store_true", help="Jukes-Cantor correction")
    for one in made.values():
        one.add_argument("inputs", nargs="*")
    return made


def usage() -> str:
    return "usage: kmerloom {sketch,dist,three,triangle,info,help} [options] inputs\n" + "".join(p.format_usage() for p in parsers().values())


def run(spark: SparkSession, argv: Sequence[str]) -> int:
    """The exit code; reports go to standard output."""
    if not argv or argv[0] not in (*_LEAST, "help"):
        if argv:
            print(f"unknown command {argv[0]}", file=sys.stderr)
        print(usage(), file=sys.stderr)
        return 1
    if argv[0] == "help":
        print(usage())
        return 0
    try:
        args = parsers()[argv[0]].parse_intermixed_args(list(argv[1:]))
    except _Usage as e:
        print(e, usage(), sep="\n", file=sys.stderr)
        return 1
    args.command = argv[0]
    if len(args.inputs) < _LEAST[args.command]:
        print(f"{args.command} needs at least {_LEAST[args.command]} inputs", file=sys.stderr)
        return 1
    try:
        if args.command == "sketch":
            params = SketchParams(args.k, args.s, args.e, args.m if args.m is not None else 2 if args.r else 0)
            records = read_sequences(spark, *args.inputs)
            if args.r:
                made = pooled_sketch(records, params, "pool")
            else:
                names = spark.createDataFrame(list(enumerate(args.inputs)), "idx int, name string")
                stem = F.regexp_replace("path", "^file:/*", "/")
                made = sketch(records.withColumn("path", stem), params, "path", "seq", names.withColumn("name", F.regexp_replace("name", "^file:/*", "/")))
            write_sketch_files(spark, made, args.o)
            return 0
        if args.command == "info":
            for r in read_sketches(spark, *args.inputs).select("name", "k", F.size("hashes").alias("size")).toLocalIterator():
                print(f"Name: {r['name'] or 'N/A'}\nK-mer size: {r['k']}\nSketch size: {r['size']}")
            return 0
        sketches = resolve_inputs(spark, list(args.inputs))
        if args.command == "triangle":
            lines = reports.triangle_text(distance.triangle(sketches, args.j), sketches.meta).orderBy("line_no")
            for r in lines.toLocalIterator():
                print(shown(r["line"]))
        else:
            pairs = (distance.dist if args.command == "dist" else distance.three)(sketches, args.j)
            pairs = pairs.withColumn("reference", F.element_at(F.split("reference", "\x1f"), -1)).withColumn("query", F.element_at(F.split("query", "\x1f"), -1))
            for r in reports.dist_report(pairs).orderBy("i", "j").collect():  # at most three
                print(r["report"], end="\n\n")
        return 0
    except (BadSketch, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    except Exception as e:  # noqa: BLE001  a failing input ends the command, as its report says
        print(str(e).splitlines()[0], file=sys.stderr)
        return 1


def main() -> int:
    spark = SparkSession.builder.appName("kmerloom").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        return run(spark, sys.argv[1:])
    finally:
        spark.stop()
