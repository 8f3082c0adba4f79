"""The scan: from files and rules to findings.

All rules go over the files in one pass, without a shuffle. Path patterns and
expressions are Spark's own filters, so that only texts with a match leave it: they go
in Arrow batches, each text once for all rules. There the expressions of rules on whole
texts run text by text, and lines, columns and offsets are computed for a whole batch
at once. ``native=True`` stays in Spark's expressions for such rules: matches and the
gaps between them are measured and folded into positions. That needs no Python and is
much slower (interpreted lambdas).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsieve.functions.chars import described, trimmed, utf16_length
from glyphsieve.functions.text import binary, context, without_bom
from glyphsieve.operators.batchscan import scanner
from glyphsieve.operators.suppress import entries, silences
from glyphsieve.operators.textscan import MARKER
from glyphsieve.plans.planner import restricted, targeted
from glyphsieve.plans.rules import Rule

FINDINGS = "rule_id string, file string, line bigint, column bigint, end_column bigint, offset bigint, match string, message string, severity string, fixable boolean, replacement string"
#: Matches that are folded into one array before it joins the others.
BLOCK = 64
COLUMNS = [c.split()[0] for c in FINDINGS.split(", ")]
INTERNAL = ("cp_offset", "context")
_EXTRA = {"cp_offset": "bigint", "context": "string", "excerpt": "string"}


def is_native(rule: Rule) -> bool:
    return rule.native and rule.positive


def _replaced(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def in_blocks(items: Column) -> Column:
    """The items of an array by BLOCK; of an empty one an empty block."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / BLOCK).cast("int")), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))


def spans(text: Column, pattern: str, wide: Column) -> Column:
    """array<struct<offset, cp_offset, line, column, end_column, match>> of the matches; linear in the text."""

    def units(part: Column) -> Column:
        return F.when(wide, utf16_length(part)).otherwise(F.length(part)).cast("long")

    def measured(part: Column, name: str) -> list[Column]:
        part = F.coalesce(part, F.lit(""))
        return [
            units(part).alias(f"{name}_units"),
            F.length(part).cast("long").alias(f"{name}_points"),
            _replaced(part, "\n").cast("long").alias(f"{name}_breaks"),
            units(F.substring_index(part, "\n", -1)).alias(f"{name}_tail"),
        ]

    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    sizes = F.transform(parts, lambda x: F.struct(x["match"].alias("match"), *measured(x["gap"], "gap"), *measured(x["match"], "match")))
    kind = "struct<offset:bigint,cp_offset:bigint,line:bigint,column:bigint,end_column:bigint,match:string>"
    empty = F.array().cast(f"array<{kind}>")

    def state(at: Column, cp: Column, line: Column, column: Column, out: Column) -> Column:
        return F.struct(at.alias("at"), cp.alias("cp"), line.alias("line"), column.alias("column"), out.alias("out"))

    def step(a: Column, x: Column) -> Column:
        at, cp, line = a["at"] + x["gap_units"], a["cp"] + x["gap_points"], a["line"] + x["gap_breaks"]
        column = F.when(x["gap_breaks"] > 0, x["gap_tail"] + 1).otherwise(a["column"] + x["gap_units"])
        after = F.when(x["match_breaks"] > 0, x["match_tail"] + 1).otherwise(column + x["match_units"])
        found = F.struct(at.alias("offset"), cp.alias("cp_offset"), line.alias("line"), column.alias("column"), after.alias("end_column"), x["match"].alias("match"))
        return state(at + x["match_units"], cp + x["match_points"], line + x["match_breaks"], after, F.when(x["match"].isNull(), a["out"]).otherwise(F.array_append(a["out"], found)))

    # an append copies its array, so matches are gathered in blocks, and blocks one behind the fold
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    start = F.struct(state(zero, zero, one, one, empty).alias("r"), F.array().cast(f"array<array<{kind}>>").alias("outs"))

    def block(a: Column, part: Column) -> Column:
        r = a["r"]
        return F.struct(F.aggregate(part, state(r["at"], r["cp"], r["line"], r["column"], empty), step).alias("r"), F.array_append(a["outs"], r["out"]).alias("outs"))

    def folded(all_sizes: Column) -> Column:
        return F.aggregate(in_blocks(all_sizes), start, block, lambda a: F.flatten(F.array_append(a["outs"], a["r"]["out"])))

    # the variable of a lambda is computed once, however often it is used
    return F.element_at(F.transform(F.array(sizes), folded), 1)


def _native(rows: DataFrame, rules: list[Rule], applies: dict[str, str], extra: tuple[str, ...]) -> DataFrame:
    """Findings of the rules that Spark's expressions can find; rows (file, text, wide, quiet, applies...)."""

    def of(rule: Rule) -> Column:
        found = F.filter(spans(F.col("text"), rule.java, F.col("wide")), lambda f: ~silences(F.col("quiet"), F.lit(rule.id), f["line"]))
        same = {"rule_id": F.lit(rule.id), "message": F.lit(rule.message).cast("string"), "severity": F.lit(rule.severity), "replacement": F.lit(rule.fix).cast("string")}
        return F.transform(found, lambda f: F.struct(*(v.alias(k) for k, v in same.items()), *(f[k].alias(k) for k in ("offset", "cp_offset", "line", "column", "end_column", "match"))))

    def around(f: Column) -> Column:
        kinds = {"context": lambda: context(F.col("text"), f["cp_offset"].cast("int"), F.length(f["match"])), "excerpt": lambda: F.regexp_replace(F.concat(F.substring_index(F.substring(F.col("text"), F.lit(1), f["cp_offset"].cast("int")), "\n", -1), F.substring_index(F.col("text").substr((f["cp_offset"] + 1).cast("int"), F.length(F.col("text"))), "\n", 1)), "\\r\\z", "")}
        return F.struct(f.alias("f"), *(kinds[n]().alias(n) for n in extra if n in kinds))

    parts = [F.when(F.col(applies[rule.id]), of(rule)) for rule in rules]
    every = F.transform(F.flatten(F.array_compact(F.array(*parts))), around)
    each = rows.select("file", F.explode(every).alias("e")).select("file", "e.*").select("file", "f.*", *(n for n in extra if n != "cp_offset"))
    said = F.concat(F.lit("Banned character "), described(F.when(F.length(trimmed(F.col("match"))) > 0, trimmed(F.col("match"))).otherwise(F.col("match"))))
    return each.withColumns({"message": F.coalesce("message", said), "fixable": F.col("replacement").isNotNull()})


_JSX_BLOCK = r"(?is)<script\b[^>]*\blang\s*=\s*[\"']?(?:tsx|jsx)\b"


def holds_jsx(rule: Rule) -> Column:
    """Whether the rule's scope would have to read JSX in the file."""
    name = F.lower("file")
    if rule.scope == "strings":
        return name.endswith(".tsx") | name.endswith(".jsx")
    if rule.scope == "markup":
        return name.endswith(".vue") & F.col("text").rlike(_JSX_BLOCK)
    return F.lit(False)


def targets(files: DataFrame, rules: list[Rule], ignore: tuple[str, ...], paths: Iterable[str] | DataFrame | None) -> tuple[DataFrame, dict[str, str]]:
    """((file, text) and for each rule whether it is about the file, that column's name by rule)."""
    seen: set[str] = set()
    for r in rules:
        r.check()
        if r.id in seen:
            raise ValueError(f'two rules are called "{r.id}"')
        seen.add(r.id)
    applies = {r.id: f"applies_{i}" for i, r in enumerate(rules)}
    return restricted(files.select("file", "text"), paths).withColumns({applies[r.id]: targeted(r, ignore) for r in rules}), applies


def candidates(files: DataFrame, rules: list[Rule], ignore: tuple[str, ...], paths: Iterable[str] | DataFrame | None, assume_text: bool) -> tuple[DataFrame, dict[str, str]]:
    """(files that some rule's expression matches, the column that says so for each rule)."""
    rows, applies = targets(files, rules, ignore, paths)
    rows = rows.filter("file is not null and text is not null")
    if not assume_text:
        rows = rows.filter(~binary(F.col("text")))
    rows = rows.withColumn("text", without_bom(F.col("text")))
    hits = {applies[r.id]: F.col(applies[r.id]) & F.col("text").rlike(r.java) for r in rules}
    return rows.filter(any_of(hits.values())).withColumns(hits) if hits else rows.limit(0), applies


def any_of(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def refused(rules: list[Rule], applies: dict[str, str]) -> Column:
    """Whether a rule would have to read JSX in the file."""
    return any_of(F.col(applies[r.id]) & holds_jsx(r) for r in rules if r.scope in ("strings", "markup"))


def with_rules(rows: DataFrame, rules: list[Rule], applies: dict[str, str], *more: str) -> DataFrame:
    """(file, text, on): on says for each rule whether it reads the text and its expression matches."""
    on = F.array(*(F.coalesce(F.col(applies[r.id]), F.lit(False)) for r in rules))
    return rows.select("file", "text", on.alias("on"), *more).filter(F.exists("on", lambda x: x))


def scan(files: DataFrame, rules: list[Rule | dict], *, ignore: Iterable[str] = (), paths: Iterable[str] | DataFrame | None = None, assume_text: bool = False, text_attributes: Iterable[str] | None = None, marker: str = MARKER, native: bool = False, internal: bool = False, excerpts: bool = False, jsx: bool = True) -> DataFrame:
    """Findings (FINDINGS) of a table (file, text), in no order.

    A null file or text has none; repeated rows are files of their own. Text that begins with a byte order mark is
    read without it. ``internal`` keeps cp_offset, the offset in code points, and context, the hash of what stands
    around the match; ``excerpts`` the line that it begins in. Without ``jsx`` files in which a rule would have to read
    JSX are left out (``skipped`` names them)."""
    rules = [Rule.of(r) for r in rules]
    attributes = None if text_attributes is None else tuple(text_attributes)
    extra = (*(INTERNAL if internal else ()), *(("excerpt",) if excerpts else ()))
    rows, applies = candidates(files, rules, tuple(ignore), paths, assume_text)
    if not jsx:
        rows = rows.filter(~refused(rules, applies))
    inside = [r for r in rules if native and is_native(r)]
    other = [r for r in rules if r not in inside]
    columns = [*COLUMNS, *extra]
    schema = ", ".join([FINDINGS, *(f"{n} {_EXTRA[n]}" for n in extra)])
    parts = []
    if inside:
        quiet = F.when(F.col("text").contains(f"{marker}-disable-"), entries(F.col("text"), F.col("file"), marker))
        some = rows.withColumns({"wide": F.col("text").rlike("[\\x{10000}-\\x{10FFFF}]"), "quiet": quiet})
        parts.append(_native(some, inside, applies, extra).select(*columns))
    if other:
        run = scanner(other, [is_native(r) for r in other], extra=extra, assume_text=assume_text, text_attributes=attributes, marker=marker)
        parts.append(with_rules(rows, other, applies).mapInArrow(run, schema))
    if not parts:
        return files.sparkSession.createDataFrame([], schema)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def skipped(files: DataFrame, rules: list[Rule | dict], *, ignore: Iterable[str] = (), paths: Iterable[str] | DataFrame | None = None) -> DataFrame:
    """(file, reason): files that a scan without ``jsx`` leaves out, as a rule would have to read JSX there."""
    rules = [Rule.of(r) for r in rules]
    rows, applies = candidates(files, rules, tuple(ignore), paths, False)
    return rows.filter(refused(rules, applies)).select("file", F.lit("JSX isn't read").alias("reason"))


def ordered(findings: DataFrame) -> DataFrame:
    """By file, offset and rule."""
    return findings.orderBy("file", "offset", "rule_id")
