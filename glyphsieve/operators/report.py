"""Summaries, listings, machine and human reports, and the exit code."""

from __future__ import annotations

import json
import platform
from collections.abc import Iterable
from importlib import metadata
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsieve.functions import chars, globs
from glyphsieve.plans.rules import Rule

JSON_VERSION = 1
TOOL = "glyphsieve"


def summary(findings: DataFrame) -> DataFrame:
    """One row: errors, warnings, fixable, files."""
    return findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") != "error").alias("warnings"), F.count_if(F.col("fixable")).alias("fixable"), F.count_distinct("file").alias("files"))


def by_file(findings: DataFrame) -> DataFrame:
    """(file, findings): its findings in order."""
    return findings.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("offset", "rule_id", "line", "column", "end_column", "match", "message", "severity"))).alias("findings"))


def listed(findings: DataFrame, quiet: bool = False) -> DataFrame:
    return findings.filter("severity = 'error'") if quiet else findings


def with_caret(findings: DataFrame) -> DataFrame:
    """Findings of a scan with ``excerpts``, with ``caret``, a line that points at them."""
    caret = F.concat(F.repeat(F.lit(" "), F.greatest(F.col("column") - 1, F.lit(0)).cast("int")), F.repeat(F.lit("^"), F.greatest(F.col("end_column") - F.col("column"), F.lit(1)).cast("int")))
    return findings.withColumn("caret", caret)


def json_rows(findings: DataFrame) -> DataFrame:
    """(file, offset, rule_id, json): each finding as it stands in the JSON report."""
    names = {"rule_id": "ruleId", "file": "file", "line": "line", "column": "column", "end_column": "endColumn", "offset": "offset", "match": "match", "message": "message", "severity": "severity", "fixable": "fixable", "replacement": "replacement"}
    return findings.select("file", "offset", "rule_id", F.to_json(F.struct(*(F.col(k).alias(v) for k, v in names.items()))).alias("json"))


def _in_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy("file", "offset", "rule_id")


def json_report(findings: DataFrame, quiet: bool = False) -> str:
    rows = [json.loads(r["json"]) for r in json_rows(_in_order(listed(findings, quiet))).toLocalIterator()]
    return json.dumps({"schemaVersion": JSON_VERSION, "findings": rows, "summary": summary(findings).first().asDict()}, ensure_ascii=False, indent=2)


def sarif_level(severity: Column) -> Column:
    return F.when(severity == "error", "error").otherwise("warning")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(rule_id, message): each rule once with the message of its first finding, and ``first`` for the order."""
    first = F.min(F.struct("file", "offset", "message")).alias("m")
    return findings.groupBy("rule_id").agg(first).select("rule_id", "m.message", F.struct("m.file", "m.offset", "rule_id").alias("first"))


def sarif_results(findings: DataFrame) -> DataFrame:
    return findings.select("rule_id", sarif_level(F.col("severity")).alias("level"), "message", F.col("file").alias("uri"), F.col("line").alias("start_line"), F.col("column").alias("start_column"), "end_column", "offset")


def sarif_report(findings: DataFrame, quiet: bool = False, version: str | None = None) -> str:
    shown = listed(findings, quiet)
    rules = [{"id": r["rule_id"], "shortDescription": {"text": r["message"]}} for r in sarif_rules(shown).orderBy("first").toLocalIterator()]
    results = [
        {
            "ruleId": r["rule_id"],
            "level": r["level"],
            "message": {"text": r["message"]},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["uri"]}, "region": {"startLine": r["start_line"], "startColumn": r["start_column"], "endColumn": r["end_column"]}}}],
        }
        for r in sarif_results(shown).orderBy("uri", "offset", "rule_id").toLocalIterator()
    ]
    driver: dict[str, Any] = {"name": TOOL} | ({"version": version} if version else {}) | {"rules": rules}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]}, ensure_ascii=False, indent=2)


def plural(count: int, word: str) -> str:
    return f"{count} {word}" + ("" if count == 1 else "s")


class _Paint:
    def __init__(self, on: bool):
        self.on = on

    def __call__(self, code: int, text: str) -> str:
        return f"\x1b[{code}m{text}\x1b[0m" if self.on else text


def pretty_report(findings: DataFrame, *, quiet: bool = False, color: bool = False, fixed: int = 0, baselined: int = 0) -> str:
    paint = _Paint(color)
    shown = listed(findings, quiet)
    rows = with_caret(shown if "excerpt" in shown.columns else shown.withColumn("excerpt", F.lit(None).cast("string")))
    out = []
    for r in _in_order(rows).toLocalIterator():
        out.append(paint(4, f"{r['file']}:{r['line']}:{r['column']}"))
        if r["excerpt"] is not None:
            at = r["caret"].index("^")
            out += [f"  {r['excerpt']}", "  " + " " * at + paint(31, r["caret"][at:])]
        named = chars.describe(r["match"])
        more = f" ({named})" if chars.is_invisible(r["match"]) and named not in r["message"] else ""
        label = paint(31, "error") if r["severity"] == "error" else paint(33, "warn")
        out += [f"  {label}  {paint(2, r['rule_id'])}  {r['message']}{more}", ""]
    if fixed:
        out.append(paint(32, f"{plural(fixed, 'finding')} fixed. Fixes are guesses: read what changed."))
    total = summary(findings).first()
    if total["errors"] + total["warnings"] == 0:
        out.append(paint(32, "Nothing new is banned here." if baselined else "Nothing banned is here."))
    else:
        can = paint(2, f" ({total['fixable']} fixable with --fix)") if total["fixable"] else ""
        out.append(f"{plural(total['errors'], 'error')}, {plural(total['warnings'], 'warning')} in {plural(total['files'], 'file')}{can}")
    if baselined:
        out.append(paint(2, f"The baseline accounts for {plural(baselined, 'finding')}."))
    return "\n".join(out)


def exit_code(errors: Column, warnings: Column, *, max_warnings: int | None = None, strict_stale: Column | None = None, converged: Column | None = None, skipped: Column | None = None) -> Column:
    """1 for findings (errors, too many warnings, stale entries where they count), else 2 for a run that isn't whole, else 0."""
    code = F.when(errors > 0, 1)
    if max_warnings is not None:
        code = code.when(warnings > max_warnings, 1)
    if strict_stale is not None:
        code = code.when(strict_stale > 0, 1)
    if converged is not None:
        code = code.when(~converged, 2)
    if skipped is not None:
        code = code.when(skipped > 0, 2)
    return code.otherwise(0)


def _version(name: str) -> str | None:
    try:
        return metadata.version(name)
    except metadata.PackageNotFoundError:
        return None


def issue_report(rules: Iterable[Rule], counts: DataFrame, *, ignore: Iterable[str] = (), baseline: str | bool | None = None, verbatim: bool = False, version: str = "") -> str:
    """A description of a configuration to send along with a question: no file is read, and names are replaced unless ``verbatim``."""
    hide = (lambda p: p) if verbatim else globs.anonymizer()
    seen = {r["rule_id"]: r for r in counts.collect()}
    peers = ", ".join(f"{name} {found}" for name in ("pyspark", "pyarrow", "regex") if (found := _version(name)))
    lines = ["## Configuration", "", f"{TOOL} {version}".strip() + f" on Python {platform.python_version()} with {peers}", "", f"ignore: {', '.join(hide(p) for p in ignore) or 'nothing more'}", f"baseline: {'none' if not baseline else 'in use'}", ""]
    for i, r in enumerate(rules, 1):
        what = "chars " + " ".join(chars.describe(c) for c in r.chars) if r.chars is not None else f"pattern `{chars.escaped(r.pattern)}`"
        lines += [f"### rule {i}{': ' + r.id if verbatim else ''}", "", f"- {what}", f"- scope {r.scope}, severity {r.severity}, fix {'none' if r.fix is None else 'text' if isinstance(r.fix, str) else 'function'}", f"- include {', '.join(map(hide, r.include))}"]
        if r.exclude:
            lines.append(f"- exclude {', '.join(map(hide, r.exclude))}")
        if c := seen.get(r.id):
            lines.append(f"- {plural(c['matched'], 'file')}, {c['unreadable']} of which the scope can't read")
        lines.append("")
    return "\n".join(lines)
