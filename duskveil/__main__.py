"""Command line: scan, test, rules, validate, events, stats."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .functions.text import parse_since
from .operators import audit
from .operators.rules import DEFAULT_RULES, check_rules, load_rules
from .operators.scan import scan
from .session import build_session
from .sources.tables import audit_table, inline_text, text_files

SHOWN = 50


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="duskveil", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name in ("scan", "test"):
        verb = verbs.add_parser(name)
        verb.add_argument("what", help="files to scan, or a text")
        verb.add_argument("--rules", help="file of rules instead of the default ones")
    verbs.add_parser("rules").add_argument("--rules")
    verbs.add_parser("validate").add_argument("rules")
    for name in ("events", "stats"):
        verb = verbs.add_parser(name)
        verb.add_argument("table", help="folder of audit events")
        verb.add_argument("--provider")
        verb.add_argument("--tool")
        verb.add_argument("--since", type=parse_since)
        verb.add_argument("--by", choices=("provider", "tool", "flag"), default="provider")
    args = parser.parse_args(argv)
    if args.verb in ("rules", "validate"):
        try:
            rules = check_rules(load_rules(args.rules) if args.rules else DEFAULT_RULES)
        except (ValueError, OSError) as e:
            print(f"invalid: {e}", file=sys.stderr)
            return 1
        for r in rules:
            print(f"{r.flag}\t{r.category}\t{r.severity}\t{r.action}")
        return 0
    spark = build_session("local[*]", "duskveil")
    spark.sparkContext.setLogLevel("ERROR")
    if args.verb in ("scan", "test"):
        rules = load_rules(args.rules) if args.rules else DEFAULT_RULES
        texts = text_files(spark, args.what) if args.verb == "scan" else inline_text(spark, args.what)
        found = scan(texts, ["path"], "text", rules).orderBy("path", "seq")
        found.select("path", "flag", "severity", "action", "start", "end", "hashed_value").show(1000, False)
        return 0
    events = audit.recent_filtered(audit_table(spark, args.table), args.provider, args.tool, args.since)
    if args.verb == "events":
        events.orderBy(F.desc("ts_unix"), "id").show(SHOWN, False)
    elif args.by == "flag":
        audit.top_flags(events, []).orderBy("place").show(audit.TOP_FLAGS, False)
    else:
        audit.stats_by(events, args.by).show(1000, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
