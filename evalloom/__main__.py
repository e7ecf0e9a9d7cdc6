"""Command line: ``python -m evalloom evaluate | format | convert | modes | scorers``, to be run by spark-submit or alone."""

from __future__ import annotations

import argparse
import sys

from .operators import converters, scoring
from .plans import catalog, evaluate
from .session import session
from .sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evalloom")
    p.add_argument("--master", help="the Spark master, where spark-submit doesn't give it")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("evaluate", help="score standard records")
    e.add_argument("source", nargs="+")
    e.add_argument("--out", required=True)
    e.add_argument("--annotations")
    e.add_argument("--categories", nargs="*")
    e.add_argument("--types", nargs="*")
    e.add_argument("--group", choices=list(catalog.TAXONOMY["TargetLocalization"]))
    e.add_argument("--mode", help="one coordinate mode for all records")
    e.add_argument("--family", choices=sorted(catalog.COORD_MODES), help="the mode of a model family, unless --mode says another")
    e.add_argument("--expected")
    e.add_argument("--lines", action="store_true")
    e.add_argument("--whole", action="store_true", help="the files hold JSON arrays")
    e.add_argument("--dry-run", action="store_true", help="only list the files")
    f = sub.add_parser("format", help="standard records of raw responses")
    f.add_argument("source", nargs="+")
    f.add_argument("--out", required=True)
    f.add_argument("--format", dest="form")
    f.add_argument("--mode", default="auto")
    c = sub.add_parser("convert", help="prompt records of annotations")
    c.add_argument("source")
    c.add_argument("--task", required=True, choices=sorted(converters.RULES))
    c.add_argument("--out", required=True)
    c.add_argument("--style", default="base", choices=["base", "cot"])
    c.add_argument("--form", default="base")
    sub.add_parser("modes", help="coordinate modes of model families")
    sub.add_parser("scorers", help="tasks that have a scorer")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    if a.command == "modes":
        print("\n".join(f"{k}\t{v}" for k, v in sorted(catalog.COORD_MODES.items())))
        return 0
    if a.command == "scorers":
        print("\n".join("/".join(k) for k in scoring.registered()))
        return 0
    spark = spark or session(a.master)
    if a.command == "evaluate":
        if a.dry_run:
            print("\n".join(r.file for r in readers.json_records(spark, a.source, a.whole).select("file").distinct().orderBy("file").collect()))
            return 0
        mode = a.mode or catalog.COORD_MODES.get(a.family or "")
        out = evaluate.evaluate(spark, a.source, a.annotations, a.categories, a.types, a.group, mode, a.expected, a.whole)
        out.write(a.out, " ".join(a.source), mode, a.lines)
    elif a.command == "format":
        sinks.records(evaluate.standard_records(readers.json_records(spark, a.source), a.form, a.mode).drop("file"), a.out)
    else:
        task = a.task.split("_")[0]
        prompt = converters.prompt_table(spark).where(f"task = '{task}' and style = '{a.style}' and form = '{a.form}'").first()
        sinks.json_array(converters.converted(readers.annotation_tree(spark, a.source), a.task, prompt.system, prompt.response_format).select("messages", "images"), a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
