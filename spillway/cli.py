"""Command line: sort, generate, check, print."""

from __future__ import annotations

import argparse
import sys

from .log import LOG, configure, timed
from .types import ALGORITHMS, DTYPES, MIB, Options


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spillway", description="Sort, generate and check files of fixed-width integers.")
    p.add_argument("--log", help="also add messages to this file")
    p.add_argument("--dtype", default="u32", choices=list(DTYPES))
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("sort")
    s.add_argument("input", nargs="?", default="input")
    s.add_argument("output", nargs="?", default="output")
    s.add_argument("--algorithm", default="radix", choices=ALGORITHMS)
    s.add_argument("--memory", type=int, default=100 * MIB, help="bytes, for the plan's chunks")
    s.add_argument("--parts", action="store_true", help="leave a folder of sorted parts")
    s.add_argument("--skip-sort", action="store_true", help="the input is a folder of sorted files: merge them")
    g = sub.add_parser("generate")
    g.add_argument("output", nargs="?", default="input")
    g.add_argument("--bytes", type=int, default=1500 * MIB)
    g.add_argument("--kind", default="shuffle", choices=("shuffle", "random"))
    g.add_argument("--seed", type=int, default=1)
    g.add_argument("--hash", help="write the ordered data's checksum here")
    c = sub.add_parser("check")
    c.add_argument("input", nargs="?", default="input")
    c.add_argument("output", nargs="?", default="output")
    c.add_argument("--mode", default="scan", choices=("scan", "hash"))
    c.add_argument("--hash", default="origin.hash")
    w = sub.add_parser("print")
    w.add_argument("path", nargs="?", default="output")
    w.add_argument("-n", type=int, default=20)
    return p


def main(argv: list[str] | None = None) -> int:
    from .operators.generate import write_test_data
    from .operators.sort import sort_file
    from .operators.verify import check_file
    from .plans.planning import sort_plan
    from .session import local_session
    from .sources import read_fixedbin
    from .sources.fixedbin import input_files

    a = parser().parse_args(argv)
    configure(a.log)
    spark = local_session()
    try:
        with timed(a.command):
            if a.command == "sort":
                options = Options(dtype=a.dtype, algorithm=a.algorithm, memory_bytes=a.memory, skip_sort=a.skip_sort)
                LOG.info("%s", sort_plan(sum(n for _, n in input_files(a.input)), options))
                sort_file(spark, a.input, a.output, options, assemble=not a.parts)
            elif a.command == "generate":
                LOG.info("checksum: %s", write_test_data(spark, a.output, a.bytes, a.kind, a.dtype, a.seed, a.hash))
            elif a.command == "check":
                found = check_file(spark, a.input, a.output, a.dtype, a.hash if a.mode == "hash" else None)
                LOG.info("%s", found)
                return int(not found["ok"])
            else:
                for r in read_fixedbin(spark, a.path, a.dtype, position=True).filter(f"pos < {a.n}").orderBy("pos").collect():
                    print(r["pos"], r["value"])
    except Exception as e:
        LOG.error("%s: %s", type(e).__name__, e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
