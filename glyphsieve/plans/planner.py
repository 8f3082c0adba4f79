"""Which rules read which files: path patterns as predicates on the files table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsieve.functions import globs
from glyphsieve.plans.rules import SCOPE_EXTENSIONS, Rule

DEFAULT_IGNORE = ("**/node_modules/**", "**/.git/**")


def targeted(rule: Rule, ignore: Iterable[str] = (), file: str = "file") -> Column:
    """Whether the rule is about the file; the expressions are literals, so they are compiled once."""
    include = globs.any_of([p for p in rule.include if not globs.VIRTUAL.fullmatch(p)])
    if include is None:
        return F.lit(False)
    exclude = globs.any_of([*DEFAULT_IGNORE, *ignore, *rule.exclude], dots=True)
    return F.col(file).rlike(include) & ~F.col(file).rlike(exclude)


def supported(rule: Rule, file: str = "file") -> Column:
    """Whether the rule's scope can read the file."""
    ends = SCOPE_EXTENSIONS[rule.scope]
    if ends is None:
        return F.lit(True)
    name = F.lower(file)
    found = name.endswith(ends[0])
    for e in ends[1:]:
        found = found | name.endswith(e)
    return found


def restricted(files: DataFrame, paths: Iterable[str] | DataFrame | None, inside: bool = True) -> DataFrame:
    """The files of these paths (or all others): exact ones, after normalization. Many of them come as a table (file)."""
    if paths is None:
        return files if inside else files.limit(0)
    if isinstance(paths, DataFrame):
        return files.join(paths.select("file").distinct(), "file", "left_semi" if inside else "left_anti")
    on = F.coalesce(F.col("file").isin([globs.normalized(p) for p in paths]), F.lit(False))
    return files.filter(on if inside else ~on)


def plan(files: DataFrame, rules: list[Rule], *, ignore: Iterable[str] = (), paths: Iterable[str] | DataFrame | None = None) -> DataFrame:
    """(file, rule_id, rule_ord, supported): a row for each pair of file and rule. Neither joins nor shuffles."""
    ignore = tuple(ignore)
    schema = "struct<rule_ord:int,rule_id:string,supported:boolean>"
    pairs = [F.when(targeted(r, ignore), F.struct(F.lit(i).alias("rule_ord"), F.lit(r.id).alias("rule_id"), supported(r).alias("supported"))) for i, r in enumerate(rules)]
    every = F.array_compact(F.array(*pairs)) if pairs else F.array().cast(f"array<{schema}>")
    return restricted(files, paths).select("file", F.explode(every).alias("p")).select("file", "p.rule_id", "p.rule_ord", "p.supported")


def rule_counts(files: DataFrame, rules: list[Rule], *, ignore: Iterable[str] = ()) -> DataFrame:
    """(rule_id, matched, unreadable, status) of every rule. status: "no files", "unreadable scope" or "ok". One row comes of the files."""
    ignore = tuple(ignore)
    sums = []
    for i, r in enumerate(rules):
        hit = targeted(r, ignore)
        sums += [F.count_if(hit).alias(f"m{i}"), F.count_if(hit & ~supported(r)).alias(f"u{i}")]
    one = files.agg(*sums) if sums else files.limit(0)
    rows = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.col(f"m{i}").alias("matched"), F.col(f"u{i}").alias("unreadable")) for i, r in enumerate(rules)])
    status = F.when(F.col("matched") == 0, "no files").when(F.col("matched") == F.col("unreadable"), "unreadable scope").otherwise("ok")
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("status", status)


def warnings(files: DataFrame, rules: list[Rule], *, ignore: Iterable[str] = ()) -> list[str]:
    """What a user should hear about rules that check nothing."""
    found = []
    for r in rule_counts(files, rules, ignore=ignore).filter("status <> 'ok'").collect():
        if r["status"] == "no files":
            found.append(f'rule "{r["rule_id"]}" is about no file at all; directories with a leading dot are entered only by patterns that name them')
        else:
            found.append(f'rule "{r["rule_id"]}" is about {r["matched"]} file(s), none of which its scope can read, so it checks nothing')
    return found
