"""Fixes: findings with a replacement, written into the texts, again until nothing is left to fix.

A file's fixes depend on that file alone, so all passes over it run where its text is:
one projection, no shuffle, and texts in which nothing is found stay in Spark's scan."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsieve.functions.chars import BOM
from glyphsieve.functions.sentences import FIXES
from glyphsieve.functions.text import binary, looks_binary, strip_bom, without_bom
from glyphsieve.operators.batchscan import slices
from glyphsieve.operators.scan import any_of, in_blocks, scan, targets, with_rules
from glyphsieve.operators.textscan import MARKER, Units, matches_of
from glyphsieve.plans.planner import restricted
from glyphsieve.plans.rules import Rule
from glyphsieve.sources.tables import kept

MAX_PASSES = 10
APPLIED = "file string, text string, fixed int, overlap int, stale int"
_ARROW = pa.schema([("file", pa.string()), ("text", pa.string()), ("fixed", pa.int32()), ("overlap", pa.int32()), ("stale", pa.int32())])
SKIPPED = "array<struct<offset:bigint,rule_id:string,match:string,replacement:string,reason:string>>"
DONE = f"file string, text string, held boolean, fixed int, overlap int, stale int, more boolean, steps array<string>, skipped {SKIPPED}"


def unfit(text: str, findings: list[dict]) -> tuple[list[dict], list[tuple[dict, str]]]:
    """(findings that can be written, from the end to the beginning; the others and why): of two that overlap the later one
    is written, and one whose match isn't there any more is left. Offsets are UTF-16."""
    source, _ = strip_bom(text)
    units = source.encode("utf-16-le", "surrogatepass")
    wide = len(units) != 2 * len(source)
    before, fit, rest = len(source), [], []
    for f in sorted((f for f in findings if f["replacement"] is not None), key=lambda f: -f["offset"]):
        at = len(units[: 2 * f["offset"]].decode("utf-16-le", "ignore")) if wide else f["offset"]
        end = at + len(f["match"])
        if fit and end > before:
            rest.append((f, "overlap"))
        elif source[at:end] != f["match"]:
            rest.append((f, "stale"))
        else:
            fit.append(f | {"at": at})
            before = at
    return fit, rest


def written_in(text: str, fit: list[dict]) -> str:
    """The text with what ``unfit`` lets through."""
    source, bom = strip_bom(text)
    parts: list[str] = []
    tail = len(source)
    for f in fit:
        parts += (source[f["at"] + len(f["match"]) : tail], f["replacement"])
        tail = f["at"]
    return (BOM if bom else "") + source[:tail] + "".join(reversed(parts)) if fit else text


def apply_fixes(text: str, findings: list[dict], on_skipped: Callable[[dict, str], None] | None = None) -> tuple[str, int, int, int]:
    """(text, fixed, overlaps, stale) from findings with offset (UTF-16), match and replacement. on_skipped gets each finding that isn't written and why."""
    fit, rest = unfit(text, findings)
    for f, why in rest if on_skipped else ():
        on_skipped(f, why)
    overlap = sum(why == "overlap" for _, why in rest)
    return written_in(text, fit), len(fit), overlap, len(rest) - overlap


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chain.from_iterable(map(slices, batches)):
        rows = []
        for file, text, found in zip(*(b.column(c).to_pylist() for c in ("file", "text", "found")), strict=True):
            rows.append((file, *apply_fixes(text, found)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def fixed_files(files: DataFrame, findings: DataFrame) -> DataFrame:
    """APPLIED: a row for each file with a fixable finding, from findings of another scan. One shuffle, by file; ``fixed`` needs none."""
    fixable = findings.filter("replacement is not null")
    one = F.struct("offset", "rule_id", "match", "replacement")
    grouped = fixable.groupBy("file").agg(F.array_sort(F.collect_list(one)).alias("found"))
    return files.select("file", "text").join(grouped, "file").mapInArrow(_folded, APPLIED)


#: Code points in a piece of a text.
PIECE = 256


def folded(text: Column, found: Column) -> Column:
    """struct<text, fixed, overlap, stale> in Spark's own expressions, for texts without a byte order mark.

    found: array<struct<at, match, replacement>>, at in code points. To cut a text costs its length, so it is cut once into pieces,
    and from those for each match: linear in the text."""
    match = lambda f, i: F.struct((-f["at"].cast("long")).alias("back"), i.alias("i"), f["at"].cast("long").alias("at"), (f["at"] + F.length(f["match"])).cast("long").alias("end"), f["match"].alias("match"), f["replacement"].alias("replacement"))
    given = F.struct(F.sort_array(F.transform(found, match)).alias("latest"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), F.length(text).cast("long").alias("size"))
    counts = ("fixed", "overlap", "stale")

    def of(x: Column) -> Column:
        def part(begin: Column, end: Column) -> Column:
            first, last = F.floor(begin / PIECE), F.floor(end / PIECE)
            return F.array_join(F.slice(x["pieces"], (first + 1).cast("int"), (last - first + 1).cast("int")), "").substr((begin - first * PIECE + 1).cast("int"), (end - begin).cast("int"))

        def tail(a: Column) -> Column:
            return F.least(a["before"], x["size"])

        def step(a: Column, f: Column) -> Column:
            why = F.when(f["end"] > a["before"], 1).when(part(f["at"], f["end"]) != f["match"], 2).otherwise(0)

            def after(why: Column) -> Column:
                out = F.when(why == 0, F.array_append(a["out"], F.concat(f["replacement"], part(f["end"], tail(a))))).otherwise(a["out"])
                return F.struct(F.when(why == 0, f["at"]).otherwise(a["before"]).alias("before"), *((a[n] + (why == k).cast("int")).alias(n) for k, n in enumerate(counts)), out.alias("out"))

            return F.element_at(F.transform(F.array(why), after), 1)

        none = F.array().cast("array<string>").alias("out")
        start = F.struct(F.struct(F.lit(2**62).cast("long").alias("before"), *(F.lit(0).alias(n) for n in counts), none).alias("r"), F.array().cast("array<array<string>>").alias("outs"))

        def block(a: Column, some: Column) -> Column:
            r = a["r"]
            return F.struct(F.aggregate(some, F.struct(*(r[n].alias(n) for n in ("before", *counts)), none), step).alias("r"), F.array_append(a["outs"], r["out"]).alias("outs"))

        def whole(a: Column) -> Column:
            r = a["r"]
            written = F.array_join(F.reverse(F.flatten(F.array_append(a["outs"], r["out"]))), "")
            return F.struct(F.concat(part(F.lit(0).cast("long"), tail(r)), written).alias("text"), *(r[n].alias(n) for n in counts))

        return F.aggregate(in_blocks(x["latest"]), start, block, whole)

    # the variable of a lambda is computed once, however often it is used
    return F.element_at(F.transform(F.array(given), of), 1)


#: (begin, rule id, end, match, replacement) of a match, in code points of the text without its byte order mark.
Change = tuple[int, str, int, str, str]


def _writable(found: list[Change]) -> tuple[list[Change], list[Change]]:
    """(what can be written, from the end to the beginning; what overlaps it): ``unfit`` of what was found in the same text."""
    fit, rest = [], []
    before = 2**62
    for f in sorted(found, key=lambda f: -f[0]):
        if f[2] > before:
            rest.append(f)
        else:
            fit.append(f)
            before = f[0]
    return fit, rest


def _written(text: str, fit: list[Change]) -> str:
    source, bom = strip_bom(text)
    parts: list[str] = []
    tail = 0
    for a, _, b, _, new in reversed(fit):
        parts += (source[tail:a], new)
        tail = b
    return (BOM if bom else "") + "".join(parts) + source[tail:]


def _skipped(text: str, rest: list[Change]) -> list[dict]:
    units = Units(strip_bom(text)[0]) if rest else None
    return [{"offset": units(f[0]), "rule_id": f[1], "match": f[3], "replacement": f[4], "reason": "overlap"} for f in rest]


def passes_over(text: str, file: str, rules: list[Rule], most: int, *, assume_text: bool = False, counts_only: bool = False, **options: Any) -> tuple[list[str], int, int, list[dict], bool]:
    """(text after each pass that changed it, fixed, overlaps, what was not written in the last pass, whether something writable is left after ``most`` passes).

    Fixes that are texts, or functions with a name, give the same whenever a text comes again: then the passes go round, and the rest
    of them are counted and not run. ``counts_only`` leaves out what was not written and what is left."""

    def found_in(text: str) -> list[Change]:
        if not rules or not assume_text and looks_binary(text):
            return []
        plain, _ = strip_bom(text)
        found = [(a, rule.id, b, plain[a:b], new) for rule, a, b, new in matches_of(plain, file, rules, **options) if new is not None]
        return sorted(found, key=lambda f: f[:2]) if len(rules) > 1 or rules[0].scope != "raw" else found

    again = most > 2 and all(not callable(r.fix) or r.fix in FIXES.values() for r in rules)
    texts, counts, rests = [text], [], []
    fixed = overlap = 0
    skipped: tuple[str, list] = (text, [])
    seen = {text: 0} if again else {}
    while len(counts) < most and (found := found_in(texts[-1])):
        fit, rest = _writable(found)
        skipped = (texts[-1], rest)
        new = _written(texts[-1], fit)
        if new == texts[-1]:
            overlap += len(rest)
            break
        counts.append((len(fit), len(rest)))
        rests.append(skipped)
        texts.append(new)
        if again and (first := seen.setdefault(new, len(counts))) < len(counts):
            cycle = range(first, len(counts))
            for n in range(len(counts), most):
                k = cycle[(n - first) % len(cycle)]
                counts.append(counts[k])
                texts.append(texts[k + 1])
                skipped = rests[k]
            found = True
            break
    else:
        found = not counts_only and len(counts) == most and bool(found_in(texts[-1]))
    fixed += sum(n for n, _ in counts)
    overlap += sum(n for _, n in counts)
    return texts[1:], fixed, overlap, [] if counts_only else _skipped(*skipped), bool(found) and len(counts) == most


def _fixing(rules: list[Rule], most: int, every_step: bool, counts_only: bool, options: dict[str, Any]):
    skipped_type = pa.list_(pa.struct([("offset", pa.int64()), ("rule_id", pa.string()), ("match", pa.string()), ("replacement", pa.string()), ("reason", pa.string())]))
    types = [pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string()), skipped_type]
    names = ["file", "text", "held", "fixed", "overlap", "stale", "more", "steps", "skipped"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(map(slices, batches)):
            rows = []
            for file, text, on, held in zip(*(b.column(c).to_pylist() for c in ("file", "text", "on", "held")), strict=True):
                own = [r for r, o in zip(rules, on, strict=True) if o]
                try:
                    steps, fixed, overlap, skipped, more = passes_over(text, file, own, 0 if held else most, counts_only=counts_only, **options)
                except ValueError as cause:
                    raise ValueError(f"{file}: {cause}") from cause
                rows.append((file, steps[-1] if steps else text, held, fixed, overlap, 0, more and len(steps) == most, steps if every_step else None, skipped))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def _run(files: DataFrame, rules: list[Rule | dict], most: int, hold: DataFrame | None, every_step: bool, ignore: Iterable[str], paths: Iterable[str] | DataFrame | None, assume_text: bool, text_attributes: Iterable[str] | None, marker: str, counts_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(DONE of the files that rules match and may fix, (file, text) of all others)."""
    rules = [Rule.of(r) for r in rules]
    attributes = None if text_attributes is None else tuple(text_attributes)
    # a fix may make what another rule matches: rules read the files that they are about, once any of them matches
    inside, applies = targets(files, rules, tuple(ignore), paths)
    text = F.col("text")
    hit = any_of(F.col(applies[r.id]) & without_bom(text).rlike(r.java) for r in rules)
    if not assume_text:
        hit = hit & ~binary(text)
    inside = inside.withColumn("hit", F.coalesce(hit, F.lit(False)))
    rows = inside.filter("hit")
    if hold is None:
        rows = rows.withColumn("held", F.lit(False))
    else:
        rows = rows.join(hold.select("file").distinct().withColumn("held", F.lit(True)), "file", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    options = {"assume_text": assume_text, "text_attributes": attributes, "marker": marker}
    done = with_rules(rows, rules, applies, "held").mapInArrow(_fixing(rules, most, every_step, counts_only, options), DONE)
    others = inside.filter("not hit").select("file", "text")
    if paths is not None:
        others = others.unionByName(restricted(files.select("file", "text"), paths, inside=False))
    return done, others


def fixed(files: DataFrame, rules: list[Rule | dict], *, ignore: Iterable[str] = (), paths: Iterable[str] | DataFrame | None = None, assume_text: bool = False, text_attributes: Iterable[str] | None = None, marker: str = MARKER) -> DataFrame:
    """APPLIED: a row for each file with a fixable finding, after one pass. No shuffle."""
    done, _ = _run(files, rules, 1, None, False, ignore, paths, assume_text, text_attributes, marker, counts_only=True)
    return done.filter("fixed + overlap + stale > 0").select("file", "text", "fixed", "overlap", "stale")


@dataclass
class Fixed:
    """What is left to report (with cp_offset, context and excerpt), the new texts of all files and of those that changed, what was not
    written and why, and how it went."""

    findings: DataFrame
    files: DataFrame
    fixed: int
    changed: DataFrame
    converged: bool
    skipped: DataFrame
    warnings: list[str] = field(default_factory=list)


def fix_to_fixpoint(files: DataFrame, rules: list[Rule | dict], *, hold: DataFrame | None = None, after_pass: Callable[[DataFrame], None] | None = None, max_passes: int = MAX_PASSES, ignore: Iterable[str] = (), paths: Iterable[str] | DataFrame | None = None, assume_text: bool = False, text_attributes: Iterable[str] | None = None, marker: str = MARKER) -> Fixed:
    """Scans and fixes each file until nothing changes in it, nothing writable is left, or the passes run out.

    ``hold`` (file) names files that are reported and not written. ``after_pass`` gets (file, text) of what each pass
    changed, pass by pass. Texts that no rule matches are neither moved nor written."""
    ignore, text_attributes = tuple(ignore), None if text_attributes is None else tuple(text_attributes)
    made, others = _run(files, rules, max_passes, hold, after_pass is not None, ignore, paths, assume_text, text_attributes, marker)
    done = kept(made)
    sums = done.agg(F.sum("fixed"), F.sum("stale"), F.count_if("more"), F.max(F.size("steps"))).first()
    for number in range(1, (sums[3] or 0) + 1 if after_pass is not None else 0):
        after_pass(done.filter(F.size("steps") >= number).select("file", F.element_at("steps", number).alias("text")))
    warnings = []
    if sums[1]:
        warnings.append(f"{sums[1]} finding(s) were not fixed, as the text there isn't what was scanned")
    if sums[2]:
        warnings.append(f"the text of {sums[2]} file(s) still changes after {max_passes} passes: two rules undo each other's fixes")
    # what is left is found when somebody asks for it: a line for each finding in it would fill the table
    findings = scan(done.select("file", "text"), rules, ignore=ignore, assume_text=assume_text, text_attributes=text_attributes, marker=marker, internal=True, excerpts=True)
    texts = others.unionByName(done.select("file", "text"))
    skipped = done.select("file", F.explode("skipped").alias("s")).select("file", "s.*")
    return Fixed(findings, texts, int(sums[0] or 0), done.filter("fixed > 0").select("file", "text"), not sums[2], skipped, warnings)
