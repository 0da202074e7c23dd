"""python -m codestrata: check, rules, baseline, graph and explain, over folders of PHP files."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from codestrata.operators import graph, policy, rules
from codestrata.run import Run, analyse
from codestrata.session import build_session
from codestrata.sinks import formats
from codestrata.sources.baseline import baseline_json, content_hash, read_lines, write_baseline
from codestrata.sources.config import merge, yaml_layer
from codestrata.sources.files import discover

FORMATS = {"text": formats.text_lines, "github": formats.github_lines, "gitlab": formats.gitlab, "sarif": formats.sarif_results, "checkstyle": formats.checkstyle, "json": formats.findings_json}


def arguments(argv: Sequence[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="codestrata")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("check", "baseline", "graph"):
        p = commands.add_parser(name)
        p.add_argument("paths", nargs="+")
        p.add_argument("--config")
        p.add_argument("--baseline")
        p.add_argument("--only", action="append", default=[])
        p.add_argument("--disable", action="append", default=[])
        p.add_argument("--output", help="a folder to write to instead of the screen")
        if name == "check":
            p.add_argument("--format", choices=sorted(FORMATS), default=None)
            p.add_argument("--fail-on", choices=("error", "warning", "none"), default=None)
        if name == "graph":
            p.add_argument("--format", choices=("dot", "json"), default="dot")
            p.add_argument("--namespace", action="append", default=[])
    commands.add_parser("rules")
    return top.parse_args(argv)


def run(spark: SparkSession, args: argparse.Namespace) -> tuple[Run, dict]:
    layers: list[tuple[str, dict]] = [("defaults", {"failOn": "error", "format": "text"})]
    if args.config:
        layers.append(("file", yaml_layer(Path(args.config).read_text())))
    given = {"failOn": getattr(args, "fail_on", None), "format": getattr(args, "format", None), "onlyRules": args.only or None, "disabledRules": args.disable or None}
    layers.append(("cli", {k: v for k, v in given.items() if v is not None}))
    settings = merge(layers)
    baseline = read_lines(spark.read.text(args.baseline)) if args.baseline and args.command == "check" else None
    done = analyse(
        discover(spark, args.paths), settings.get("rules"), settings.get("onlyRules", ()), settings.get("disabledRules", ()), settings.get("excludePaths", ()), settings.get("excludeNamespaces", ()), baseline, settings=settings
    )
    return done, settings


def show(lines: DataFrame, folder: str | None) -> None:
    """Lines written to a folder, or printed as they arrive, a partition at a time."""
    if folder:
        lines.write.mode("overwrite").text(folder)
        return
    for row in lines.toLocalIterator():
        print(row[0])


def main(argv: Sequence[str], spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    if args.command == "rules":
        for rule in rules.RULES:
            print(f"{rule.channel} {rule.warning} {rule.error}{'' if rule.enabled else ' off'}")
        for name, level, _ in rules.ENTRY_RULES.values():
            print(f"{name}#{name} {level}")
        return 0
    spark = spark or build_session("local[*]")
    done, settings = run(spark, args)
    if args.command == "graph":
        edges = graph.edge_export(graph.in_namespaces(done.edges, args.namespace))
        show(formats.dot_lines(edges) if args.format == "dot" else formats.graph_json(edges), args.output)
        return 0
    if args.command == "baseline":
        lines = baseline_json(policy.generate_baseline(done.kept()))
        if args.baseline:
            old = content_hash(spark.read.text(args.baseline)) if Path(args.baseline).exists() else None
            print(write_baseline(lines, args.baseline, old))
        else:
            show(lines, args.output)
        return 0
    show(FORMATS[settings["format"]](done.kept().drop("finding_id", "suppressed_by", "verdict", "in_scope", "removed_by", "identity_key", "accepted")), args.output)
    return done.verdict().first()["exit_code"]


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
