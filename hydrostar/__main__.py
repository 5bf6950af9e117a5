"""Command line: run a query, a derived result or a page and print it.

  python -m hydrostar list
  python -m hydrostar run Q10 --tables DIR [--param year=2025] [--rows 50]
  python -m hydrostar run P24d --tables DIR --param year=2024
  python -m hydrostar run Q10_monthly_evolution --fixture /root/testdata/sf0.01
  python -m hydrostar page temporal --tables DIR --param year=2024

``--tables`` reads the ten engine tables (``DIR/<table>.parquet``) with the
dashboard's default parameters; ``--fixture`` reads the driver's test tables,
and a registered key then runs with its bound parameters.  A parameter goes to
every result that takes it, also to the base query below a derived result; an
unknown one is an error.  All rows are printed unless ``--rows`` limits them.
``--fact-bytes`` and ``--cores`` size the session for a cluster.
"""

from __future__ import annotations

import argparse
import ast

from hydrostar.session import build_session, scale_settings


def _value(text: str):
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="hydrostar")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    for name in ("run", "page"):
        p = sub.add_parser(name)
        p.add_argument("target")
        src = p.add_mutually_exclusive_group(required=True)
        src.add_argument("--tables")
        src.add_argument("--fixture")
        p.add_argument("--format", default="parquet")
        p.add_argument("--param", action="append", default=[])
        p.add_argument("--rows", type=int)
        p.add_argument("--master")
        p.add_argument("--fact-bytes", type=int)
        p.add_argument("--cores", type=int)
    args = ap.parse_args(argv)

    from hydrostar.plans import catalog, pages

    if args.cmd == "list":
        for key, (fn, _) in catalog.REGISTRY.items():
            print(f"{key:40s} {(fn.__doc__ or '').strip().splitlines()[0]}")
        for name, ids in pages.PAGES.items():
            print(f"page {name:35s} {' '.join(ids)}")
        return 0

    sized = None
    if args.fact_bytes and args.cores:
        sized = scale_settings(args.fact_bytes, args.cores)
    spark = build_session(args.master, extra=sized)
    params = dict(kv.split("=", 1) for kv in args.param)
    params = {k: _value(v) for k, v in params.items()}
    if args.fixture:
        from hydrostar.sources.fixture import fixture_tables

        tables = fixture_tables(spark, args.fixture)
    else:
        from hydrostar.sources.tables import load_tables

        tables = load_tables(spark, args.tables, args.format)

    if args.cmd == "page":
        from hydrostar.plans.reuse import ResultStore

        if args.target not in pages.PAGES:
            raise SystemExit(f"unknown page {args.target!r}; see `python -m hydrostar list`")
        given = _assigned(pages.PAGES[args.target], params)
        for rid, df in pages.page(args.target, tables, ResultStore(spark), given).items():
            print(f"== {rid}")
            _show(df, args.rows)
        return 0

    if args.fixture and args.target in catalog.REGISTRY:
        if params:
            raise SystemExit("a registered key has bound parameters; use its id (e.g. Q10) instead")
        _show(catalog.REGISTRY[args.target][0](spark, args.fixture), args.rows)
        return 0
    rid = catalog.result_id(args.target)
    if rid is None:
        raise SystemExit(f"unknown query {args.target!r}; see `python -m hydrostar list`")
    _show(pages.result(rid, tables, _assigned([rid], params)), args.rows)
    return 0


def _assigned(ids, params):
    from hydrostar.plans import pages

    try:
        return pages.assign(ids, params)
    except ValueError as error:
        raise SystemExit(str(error)) from None


def _show(df, rows: int | None) -> None:
    """Print every row, or the first ``rows``."""
    print("\t".join(df.columns))
    for row in df.limit(rows).collect() if rows is not None else df.toLocalIterator():
        print("\t".join("NULL" if v is None else str(v) for v in row))


if __name__ == "__main__":
    raise SystemExit(main())
