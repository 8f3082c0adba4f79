"""The command line: a scan of a folder, of what is staged, or of a commit message."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.operators import baseline as known
from glyphsieve.operators import fix, messages, report
from glyphsieve.operators.scan import ordered, scan
from glyphsieve.plans import config as configs
from glyphsieve.plans.planner import DEFAULT_IGNORE, rule_counts, warnings
from glyphsieve.plans.rules import RuleError, UnsupportedScopeError, virtual_rules
from glyphsieve.sources import files as sources
from glyphsieve.sources.tables import kept

VERSION = "0.1.0"
OK, FOUND, FAILED = 0, 1, 2


class UsageError(ValueError):
    """Options that don't go together."""


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise UsageError(message)


def parse(args: list[str]) -> argparse.Namespace:
    p = _Parser(prog="glyphsieve", description="Finds banned characters and patterns in texts.")
    p.add_argument("paths", nargs="*", help="only these files, if the rules are about them")
    p.add_argument("--config", metavar="PATH")
    p.add_argument("--fix", action="store_true", help="write fixes, then report what is left")
    p.add_argument("--staged", action="store_true", help="scan what is staged in git")
    p.add_argument("--commit-msg", metavar="FILE")
    p.add_argument("--format", choices=("pretty", "json", "sarif"), default="pretty")
    p.add_argument("--max-warnings", metavar="N")
    p.add_argument("--quiet", action="store_true", help="list errors only")
    p.add_argument("--baseline", action="store_true", default=None, dest="baseline")
    p.add_argument("--no-baseline", action="store_true")
    p.add_argument("--baseline-write", action="store_true")
    p.add_argument("--baseline-strict", action="store_true")
    p.add_argument("--report-issue", action="store_true")
    p.add_argument("--verbatim", action="store_true")
    p.add_argument("--no-color", action="store_true")
    p.add_argument("--version", action="store_true")
    o = p.parse_args(args)
    if o.max_warnings is not None:
        if not o.max_warnings.isdecimal():
            raise UsageError("--max-warnings takes a whole number")
        o.max_warnings = int(o.max_warnings)
    partial = bool(o.paths) or o.staged or o.commit_msg is not None
    for wrong, what in (
        (o.staged and o.commit_msg is not None, "--staged and --commit-msg are different scans"),
        (o.fix and o.commit_msg is not None, "--fix doesn't rewrite messages"),
        (o.staged and o.paths, "--staged takes no paths"),
        (o.baseline and o.no_baseline, "--baseline and --no-baseline contradict each other"),
        (o.no_baseline and (o.baseline_write or o.baseline_strict), "--no-baseline leaves nothing to write or to hold against"),
        (o.commit_msg is not None and (o.baseline or o.baseline_write or o.baseline_strict), "messages have no baseline"),
        (o.baseline_write and partial, "--baseline-write records a whole scan"),
        (o.baseline_write and o.fix, "--baseline-write and --fix are two steps"),
        (o.verbatim and not o.report_issue, "--verbatim belongs to --report-issue"),
        (o.report_issue and (partial or o.fix or o.baseline or o.no_baseline or o.baseline_write or o.baseline_strict or o.quiet or o.max_warnings is not None or o.format != "pretty"), "--report-issue scans nothing"),
    ):
        if wrong:
            raise UsageError(what)
    return o


def _use_baseline(loaded: configs.Loaded, o: argparse.Namespace) -> str | None:
    if o.commit_msg is not None:
        return None
    given = loaded.config.get("baseline")
    reads = False if o.no_baseline else bool(o.baseline or o.baseline_strict or given)
    if not reads and not o.baseline_write:
        return None
    return os.path.join(loaded.root, given if isinstance(given, str) else known.FILENAME)


def run(args: list[str], spark: Callable[[], SparkSession], out: Callable[[str], None] = print, say: Callable[[str], None] = lambda s: print(s, file=sys.stderr), cwd: str = ".") -> int:
    """The exit code. ``spark`` gives the session once it is needed."""
    try:
        o = parse(args)
        if o.version:
            out(VERSION)
            return OK
        loaded = configs.load(cwd, o.config)
        return _run(o, loaded, spark(), out, say, cwd)
    except (UsageError, configs.ConfigError, configs.ConfigNotFoundError, RuleError, UnsupportedScopeError, sources.GitError, known.BaselineError) as cause:
        say(str(cause))
        return FAILED


def _run(o: argparse.Namespace, loaded: configs.Loaded, spark: SparkSession, out: Callable[[str], None], say: Callable[[str], None], cwd: str) -> int:
    options = configs.scan_options(loaded)
    rules = options["rules"]
    hold = None
    if o.commit_msg is not None:
        rules = virtual_rules(loaded.rules, "commit-msg")
        if not rules:
            return OK
        with open(os.path.join(cwd, o.commit_msg), encoding="utf-8", errors="replace", newline="") as f:
            text = f.read()
        name = os.path.basename(o.commit_msg)
        files = spark.createDataFrame([(name, text)], sources.FILES)
        sign = sources.comment_char(cwd, text)
        prepared = messages.prepared(files, comment=sign)
        pretty = o.format == "pretty"
        everywhere = [r.__class__(**{k: getattr(r, k) for k in r.__dataclass_fields__} | {"include": ("**",), "exclude": ()}) for r in rules]
        found = scan(prepared.filter("not generated").select("file", "text"), everywhere, assume_text=True, internal=True, excerpts=pretty)
        return _report(o, found, None, out, say)
    if o.staged:
        root = sources.repo_root(cwd)
        inside = os.path.relpath(os.path.realpath(loaded.root), root)
        head = "" if inside == "." else sources.to_posix(inside) + "/"
        names = [p for p in sources.staged_files(root) if p.startswith(head)]
        files = spark.createDataFrame([(p[len(head) :], sources.staged_content(root, p)) for p in names], sources.FILES)
        dirty = [p[len(head) :] for p in sources.dirty_files(root) if p.startswith(head)]
        hold = spark.createDataFrame([(p,) for p in dirty], "file string")
        scope = files.select("file")
    else:
        files = sources.folder(spark, loaded.root, ignore=[*DEFAULT_IGNORE, *options["ignore"]])
        scope = None
        if o.paths:
            options["paths"] = [os.path.relpath(os.path.join(os.path.realpath(cwd), p), os.path.realpath(loaded.root)) for p in o.paths]
            scope = spark.createDataFrame([(sources.normalized(p),) for p in options["paths"]], "file string")
    if o.report_issue:
        counts = rule_counts(files, rules, ignore=options["ignore"])
        out(report.issue_report(rules, counts, ignore=options["ignore"], baseline=loaded.config.get("baseline"), verbatim=o.verbatim, version=VERSION))
        return OK
    if not o.staged:
        for r in sources.unreadable(spark, loaded.root, [*DEFAULT_IGNORE, *options["ignore"]]).collect():
            say(f"{r['file']} can't be read: {r['error']}")
        for w in warnings(files, rules, ignore=options["ignore"]):
            say(w)

    def again(texts: DataFrame) -> DataFrame:
        return scan(texts, **options, internal=True, excerpts=o.format == "pretty")

    fixed, converged = 0, True
    if o.fix:
        for file in sorted(r[0] for r in hold.collect()) if hold is not None else ():
            say(f"{file} is staged in part, so it isn't rewritten")
        done = fix.fix_to_fixpoint(files, hold=hold, **options)
        names = []
        for r in done.changed.toLocalIterator():
            with open(os.path.join(loaded.root, r["file"]), "w", encoding="utf-8", newline="") as f:
                f.write(r["text"])
            names.append(r["file"])
        if o.staged and names:
            sources.stage(loaded.root, sorted(names))
        for w in done.warnings:
            say(w)
        found, fixed, converged = done.findings, done.fixed, done.converged
    else:
        found = again(files)
    return _report(o, found, (_use_baseline(loaded, o), scope), out, say, fixed, converged)


def _report(o: argparse.Namespace, found: DataFrame, use: tuple[str | None, DataFrame | None] | None, out: Callable[[str], None], say: Callable[[str], None], fixed: int = 0, converged: bool = True) -> int:
    path, scope = use or (None, None)
    spark = found.sparkSession
    found = kept(found)
    accounted = stale = 0
    if path is not None and o.baseline_write:
        known.write(known.entries_for(found), path)
        say(f"recorded {report.plural(found.count(), 'finding')} in {path}")
        return OK
    if path is not None:
        entries = known.read(spark, path)
        if entries is None:
            say(f"there is no baseline at {path}, so every finding is new")
        else:
            parts = known.split(found, entries, scope)
            gone = parts.stale.collect()
            accounted = parts.baselined.count()
            if o.fix and fixed:
                known.write(known.pruned(entries, parts.baselined, scope), path)
                gone = []
            stale = len(gone)
            if stale:
                say(f"{report.plural(stale, 'entry') if stale == 1 else f'{stale} entries'} of the baseline have no finding any more")
            found = kept(parts.reported)
    shown = ordered(found.drop("cp_offset", "context"))
    if o.format == "json":
        out(report.json_report(shown, o.quiet))
    elif o.format == "sarif":
        out(report.sarif_report(shown, o.quiet, VERSION))
    else:
        out(report.pretty_report(shown, quiet=o.quiet, color=not o.no_color and sys.stdout.isatty(), fixed=fixed, baselined=accounted))
    code = report.exit_code(F.col("errors"), F.col("warnings"), max_warnings=o.max_warnings, strict_stale=F.lit(stale) if o.baseline_strict else None, converged=F.lit(converged))
    return report.summary(found).select(code.alias("code")).first()["code"]


def main() -> None:
    def session() -> SparkSession:
        s = SparkSession.builder.appName("glyphsieve").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        s.sparkContext.setLogLevel("ERROR")
        return s

    sys.exit(run(sys.argv[1:], session))


if __name__ == "__main__":
    main()
