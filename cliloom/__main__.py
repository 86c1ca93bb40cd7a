"""python -m cliloom FOLDER COMMAND ...: the catalog from the command line."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import catalog as C
from .operators import compare as D
from .operators import extract as X
from .store import Catalog


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cliloom", description=__doc__)
    p.add_argument("folder")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("create", "distros", "stats", "check"):
        sub.add_parser(name)
    page = sub.add_parser("page")
    page.add_argument("name")
    page.add_argument("--raw", action="store_true")
    for s in (page, explain := sub.add_parser("explain")):
        s.add_argument("--distro")
        s.add_argument("--release")
    explain.add_argument("line")
    sections = sub.add_parser("sections")
    sections.add_argument("distro")
    sections.add_argument("release")
    sub.add_parser("pages").add_argument("prefix")
    sub.add_parser("mappings").add_argument("--prefix")
    sub.add_parser("events").add_argument("-n", type=int, default=20)
    sub.add_parser("diff", help="parsed pages in a Parquet folder against the stored ones").add_argument("fresh")
    pair = sub.add_parser("diff-extractors", help="two extractors, A..B, on the stored raw pages below a prefix")
    pair.add_argument("pair")
    pair.add_argument("--prefix", default="")
    plan = sub.add_parser("plan", help="what an extraction would do with the files of a Parquet table (pos, source, sha, length, canonical)")
    plan.add_argument("files")
    plan.add_argument("--overwrite", action="store_true")
    plan.add_argument("--size", choices=("both", "small", "large"), default="both")
    return p


def show(df: DataFrame, most: int = 1000) -> None:
    """The rows, and how many there are besides."""
    df.show(most, False)
    if left := df.offset(most).count():
        print(f"and {left} more")


def shown_event(row) -> str:
    """An event's line, and those of its report's counts."""
    metadata = json.loads(row.metadata or "{}")
    lines = [f"{row.timestamp:%Y-%m-%d %H:%M:%S} {row.event}"]
    return "\n".join(lines + [f"  {k}: {json.dumps(v, sort_keys=True) if isinstance(v, dict | list) else v}" for k, v in sorted(metadata.items())])


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    if a.command in ("page", "explain") and bool(a.distro) != bool(a.release):
        print("--distro and --release go together", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("cliloom").getOrCreate()
    catalog = Catalog(spark, a.folder, read_only=a.command != "create")
    if getattr(a, "distro", None) and not C.known_scope(catalog.parsed, a.distro, a.release):
        print(f"no pages of {a.distro}/{a.release}", file=sys.stderr)
        return 1
    if a.command == "create":
        catalog.create()
    elif a.command == "check":
        issues = catalog.check()
        show(issues.orderBy("severity", "code", "message"))
        return int(C.has_errors(issues))
    elif a.command == "page":
        won, others = catalog.page(a.name, a.distro, a.release)
        rows = won.collect()  # one row
        if not rows:
            print(f"no page for {a.name}", file=sys.stderr)
            return 1
        if a.raw:
            print(catalog.raw_page(rows[0].source).first().text)
        else:
            print(f"{rows[0].name}({rows[0].section}): {rows[0].synopsis}")
            for o in rows[0].options:
                print("  " + ", ".join([*o.short, *o.long, *([o.positional] if o.positional else [])]) + "\n    " + o.text.replace("\n", "\n    "))
            for r in others.limit(50).collect():
                print(f"also: {r.source}")
            if left := others.offset(50).count():
                print(f"and {left} more")
    elif a.command == "explain":
        line = spark.createDataFrame([(1, a.line)], "query_id long, cmd string")
        spans = catalog.explain(line, a.distro, a.release) if a.distro else catalog.explain_preferring(line)
        spans.where("group_no >= 0 or error is not null").select("start", "end", "match", "kind", "text", "error").orderBy("start").show(1000, False)  # one line's spans
    elif a.command == "events":
        for row in catalog.events(a.n).collect():
            print(shown_event(row))
    elif a.command == "diff":
        fields, options = catalog.diff(spark.read.parquet(a.fresh))
        show(fields.orderBy("source", "field"))
        show(options.orderBy("source", "place"))
    elif a.command == "diff-extractors":
        left, _, right = a.pair.partition("..")
        pages = C.with_prefix(catalog.raw, "source", a.prefix).select("source", "text")
        results = D.paired_outcomes(*(X.extract(pages, model)[0] for model in (left, right)))
        show(results.groupBy("outcome", "reason").agg(F.count("*").alias("n")).orderBy("outcome", "reason"))
        return int(not results.where("outcome = 'failed'").isEmpty())
    elif a.command == "plan":
        decisions = catalog.plan(spark.read.parquet(a.files), overwrite=a.overwrite, size=a.size)
        show(D.plan_counts(decisions))
        show(decisions.orderBy("pos"))
    else:
        out = {"distros": catalog.distros, "stats": catalog.stats, "sections": lambda: catalog.sections(a.distro, a.release), "pages": lambda: catalog.pages_below(a.prefix), "mappings": lambda: catalog.mappings_below(a.prefix)}[a.command]()
        show(out, 10_000)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
