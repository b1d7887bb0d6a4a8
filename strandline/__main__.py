"""python -m strandline list | run QUERY --data DIR [--out DIR] [--limit N] | --store DIR COMMAND [--option value ...]

COMMAND is one of those that `python -m strandline commands` prints, `serve` (HTTP) or `mcp` (tools over standard input)."""

from __future__ import annotations

import argparse
import inspect
import json

from pyspark.sql import DataFrame

from strandline.plans.catalogue import QUERIES
from strandline.session import session
from strandline.surfaces.commands import COMMANDS, Store, options


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--store", default=".", help="folder of tables that commands work on")
    p.add_argument("--out", help="write result tables as Parquet into this folder instead of printing them")
    p.add_argument("--limit", type=int, default=20, help="rows to print")
    top = p.add_subparsers(dest="command", required=True)
    top.add_parser("list", help="names of the registered queries")
    top.add_parser("commands", help="names of the commands")
    run = top.add_parser("run", help="a registered query")
    run.add_argument("query", choices=sorted(QUERIES), metavar="QUERY")
    run.add_argument("--data", required=True, help="folder of Parquet tables")
    web = top.add_parser("serve", help="HTTP server of the commands")
    web.add_argument("--host", default="127.0.0.1")
    web.add_argument("--port", type=int, default=8000)
    top.add_parser("mcp", help="tools over standard input and output")
    groups: dict = {}
    for name, f in COMMANDS.items():
        head, _, rest = name.partition(" ")
        if rest:
            if head not in groups:
                groups[head] = top.add_parser(head).add_subparsers(dest="rest", required=True)
            c = groups[head].add_parser(rest, help=(f.__doc__ or "").strip().split("\n")[0])
        else:
            c = top.add_parser(name, help=(f.__doc__ or "").strip().split("\n")[0])
        for key, (kind, default) in options(f).items():
            flag = f"--{key.replace('_', '-')}"
            if kind is bool:
                c.add_argument(flag, action="store_true")
            else:
                c.add_argument(flag, type=kind, required=default is inspect.Parameter.empty, default=None if default is inspect.Parameter.empty else default)
    return p


def show(x, out: str | None, limit: int, name: str = "result") -> None:
    """Prints a result, or writes its tables whole."""
    if isinstance(x, dict):
        for k, v in x.items():
            show(v, out, limit, str(k))
    elif isinstance(x, DataFrame):
        if out:
            x.write.mode("overwrite").parquet(f"{out}/{name}")
        else:
            print(f"{name}:")
            x.show(limit, truncate=False)
    else:
        print(f"{name}: {json.dumps(x, default=str)}")


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command in ("list", "commands"):
        print("\n".join(sorted(QUERIES if a.command == "list" else COMMANDS)))
        return
    spark = session()
    if a.command == "run":
        return show(QUERIES[a.query](spark, a.data), a.out, a.limit, a.query)
    s = Store(spark, a.store)
    if a.command in ("serve", "mcp"):
        from strandline.surfaces import dispatch

        return dispatch.serve(s, a.host, a.port).serve_forever() if a.command == "serve" else dispatch.tools_over(s)
    name = f"{a.command} {a.rest}" if getattr(a, "rest", None) else a.command
    show(COMMANDS[name](s, **{k: getattr(a, k) for k in options(COMMANDS[name])}), a.out, a.limit, name.replace(" ", "-"))


if __name__ == "__main__":
    main()
