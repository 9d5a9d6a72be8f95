"""Command line: thin over the engine. Exit codes: 0 fine, 1 findings, 2 refused."""

from __future__ import annotations

import argparse
import sys

from quarrylens.settings import load


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarrylens")
    given = load()
    p.add_argument("--home", default=str(given.home))
    p.add_argument("--system", default="system")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: _add(sub, name, *args)
    add("analyze", ("root",))
    add("graph", ("root",))
    add("slice", ("root",), ("entry",), ("--depth", int, 5))
    add("extract-rules", ("root",), ("entry",), ("--depth", int, 5))
    add("rules", ("--status", str, None), ("--export", str, None))
    add("review", ("rule",), ("--decision", str, "approve"), ("--reviewer", str, None), ("--note", str, None))
    add("review-all", ("--decision", str, "approve"), ("--reviewer", str, None))
    add("validate")
    add("contract", ("root",))
    add("generate")
    add("verify", ("cases",), ("--url", str, given.new_system_url))
    add("report", ("root",))
    return p


def _add(sub, name: str, *args: tuple) -> None:
    q = sub.add_parser(name)
    for flag, *rest in args:
        q.add_argument(flag, **({"type": rest[0], "default": rest[1]} if rest else {}))


def main(argv: list[str] | None = None, spark=None) -> int:
    a, given = parser().parse_args(argv), load()
    from quarrylens.facade import Engine, NotAvailable
    from quarrylens.operators.answers import http_answers
    from quarrylens.operators.contract import ContractError
    from quarrylens.operators.system import EntryNotFound
    from quarrylens.sources.catalogs import CatalogError

    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    e = Engine(spark, a.system, a.home)
    try:
        if getattr(a, "root", None):
            s = e.analyse(a.root, cache=f"file://{given.ast_dir.resolve()}" if given.parser else None, parser=given.parser.split() or None, timeout=given.parser_timeout)
        if a.command == "analyze":
            bad = s.files.where("status <> 'OK'").count()
            print(f"{s.files.count()} files, {s.procedures.count()} procedures, {bad} not read in full")
            return int(bad > 0)
        if a.command == "graph":
            print("\n".join(e.export()))
        elif a.command == "slice":
            found = e.slice(a.entry, a.depth)
            print(found["flow"], e.write_slice(found))
        elif a.command == "extract-rules":
            cat, rejected = e.extract_rules(e.slice(a.entry, a.depth))
            print(f"{cat.count()} rules in the catalog, {rejected.count()} candidates rejected")
        elif a.command == "rules":
            cat = e.catalog()
            cat = cat.where(cat.status == a.status) if a.status else cat
            for r in cat.orderBy("rule_id").collect():
                print(r.rule_id, r.status, r.confidence, r.name)
            if a.export:
                print(e.export_catalog(a.export))
        elif a.command == "review":
            e.review(a.rule, a.decision, a.reviewer, a.note)
        elif a.command == "review-all":
            e.review_all(a.decision, a.reviewer)
        elif a.command == "validate":
            n = {r.status: r.n for r in e.catalog().groupBy("status").agg({"rule_id": "count"}).withColumnRenamed("count(rule_id)", "n").collect()}
            print(n)
            return int(n.get("candidate", 0) > 0)
        elif a.command == "contract":
            print(e.contract())
        elif a.command == "generate":
            e.generate_code(command=given.generator, timeout=given.generator_timeout)
        elif a.command == "verify":
            results, records, totals = e.verify(a.cases, http_answers(a.url) if a.url else None)
            t = totals.first()
            print(f"{t.passed} passed, {t.failed} failed, {t.skipped} skipped, {t.blocking} blocking")
            return int(not t.ok_strict)
        elif a.command == "report":
            print(e.report())
    except (NotAvailable, ContractError, EntryNotFound, CatalogError, LookupError, ValueError) as x:
        print(f"refused: {x}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
