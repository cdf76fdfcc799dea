"""Command line: list, tables, extract, cat.

    python -m blockatlas.cli list --input IMG [IMG ...] [-p sda1 sdb1] [--separator SEP]
    python -m blockatlas.cli table --input IMG --name extents
    python -m blockatlas.cli extract --input IMG --output DIR [-p ...]
    python -m blockatlas.cli cat --input IMG -p sda1 --start A --stop B --output FILE
"""

from __future__ import annotations

import argparse
import contextlib
import os
import sys

from pyspark.sql import functions as F

from .session import build_session
from .sources import diskimage, sinks
from .sources.containers import discover

EXIT_OK, EXIT_USAGE, EXIT_FAILED = 0, 1, 2


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="blockatlas")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("list", "table", "extract", "cat"):
        v = verbs.add_parser(verb)
        v.add_argument("--input", "-i", nargs="+", required=True)
        v.add_argument("--partitions", "-p", nargs="*", default=[])
        v.add_argument("--output", "-o")
        v.add_argument("--separator", default="\n", help="NUL for a zero byte")
        v.add_argument("--name", default="files")
        v.add_argument("--start", type=int, default=0)
        v.add_argument("--stop", type=int)
    return p


def extract(spark, paths: list[str], partitions: list[str], out: str) -> list[str]:
    """Each partition's device as a sparse file; the names of the files written."""
    os.makedirs(out, exist_ok=True)
    found = discover(paths, partitions)
    many = len({p.container for p in found}) > 1
    written = []
    for p in found:
        segments = diskimage.load(spark, paths, "segments", [p.name]).filter(F.col("container") == p.container)
        size = diskimage.size_of(p)
        if size is None:
            size = segments.agg(F.max("end_byte")).first()[0] or 0
        name = f"{p.container}.{p.name}.img" if many else f"{p.name}.img"
        sinks.write_image(segments, os.path.join(out, name), size)
        written.append(os.path.join(out, name))
    return written


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    separator = "\0" if a.separator == "NUL" else a.separator
    spark = build_session(master=None if "SPARK_MASTER" in os.environ else "local[*]")
    try:
        discover(a.input, a.partitions)  # names that are not there are reported before any job
        if a.verb == "list":
            files = diskimage.load(spark, a.input, "files", a.partitions)
            if a.output:
                sinks.write_listing(files, a.output, separator)
            else:
                for row in sinks.listing(files).toLocalIterator():
                    sys.stdout.write(row[0] + separator)
        elif a.verb == "table":
            df = diskimage.load(spark, a.input, a.name, a.partitions)
            if a.output:
                df.write.mode("overwrite").parquet(a.output)
            else:
                df.show(100, truncate=False)
        elif a.verb == "extract":
            if not a.output:
                raise ValueError("extract needs --output")
            extract(spark, a.input, a.partitions, a.output)
        else:
            for p in discover(a.input, a.partitions):
                size, _, read = diskimage.device(p)
                stop = min(x for x in (a.stop, size, 1 << 62) if x is not None)
                with open(a.output, "wb") if a.output else contextlib.nullcontext(sys.stdout.buffer) as f:
                    at = a.start
                    while at < stop and (data := read(at, min(1 << 22, stop - at))):
                        f.write(data)
                        at += len(data)
    except ValueError as e:
        print(e, file=sys.stderr)
        return EXIT_USAGE
    except OSError as e:
        print(e, file=sys.stderr)
        return EXIT_FAILED
    return EXIT_OK


if __name__ == "__main__":
    sys.exit(main())
