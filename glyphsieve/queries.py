"""Registered queries of the scan engine, and the same in DuckDB's SQL.

The tables hold none of the characters that the presets are about, so queries plant
them in all documents by plain replacements, the same in both languages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.functions import chars, globs
from glyphsieve.functions.sentences import clause_separator
from glyphsieve.operators import baseline, fix, messages, report
from glyphsieve.operators.scan import scan, spans
from glyphsieve.operators.suppress import suppressions, without_suppressed
from glyphsieve.operators.textscan import MARKER
from glyphsieve.plans.planner import plan, rule_counts
from glyphsieve.plans.rules import Rule, invisibles, no_ai_punctuation
from glyphsieve.sources.tables import kept

EM, EN, NBSP, ZWSP, QUOTE, ROCKET, BOM = "\u2014", "\u2013", "\u00a0", "\u200b", "\u201d", "\U0001f680", "\ufeff"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FILE = "concat('docs/', lang, '/', doc_id, '.md')"
PLANTS = {
    "plain": "text",
    "em": f"replace(text, ' | ', ' {EM} ')",
    "em_comma": f"replace(text, ', ', ' {EM} ')",
    "all": f"replace(replace(replace(replace(text, ' | ', ' {EM} '), 'ed ', 'ed{NBSP}'), '!', '{QUOTE}'), 'ß', 'ß{ZWSP}')",
    "astral": f"replace(replace(text, 'é', '{ROCKET}'), ', ', '{EM}')",
    "crlf": f"replace(replace(text, '\n', '\r\n'), ', ', ' {EM} ')",
    "bom": f"concat('{BOM}', replace(text, ', ', ' {EM} '))",
    "line": f"concat('# {MARKER}-disable-line em', '\n', replace(replace(text, ', ', ' {EM} '), '. ', '. {MARKER}-disable-line em {EM} '))",
    "next": f"replace(replace(text, ', ', ' {EM} '), '\n', '{EM} {MARKER}-disable-next-line\n')",
    "file": f"concat(replace(text, ', ', ' {EM} '), CASE WHEN doc_id % 5 = 0 THEN '\n{MARKER}-disable-file' WHEN doc_id % 5 = 1 THEN '\n{MARKER}-disable-file em' WHEN doc_id % 5 = 2 THEN '\n{MARKER}-disable-file other' ELSE '' END)",
    "fence": f"concat('```\n{MARKER}-disable-file\n```\n', replace(text, ', ', ' {EM} '))",
}


def _plant(name: str) -> str:
    # Spark's parser reads escapes in strings, so backslashes and line ends go in as they are
    return PLANTS[name]


def docs(spark: SparkSession, sf_dir: str, plant: str = "em_comma", path: str = FILE) -> DataFrame:
    return _table(spark, sf_dir, "documents").selectExpr(f"{path} AS file", f"{_plant(plant)} AS text")


def _files(plant: str = "em_comma", path: str = FILE) -> str:
    return f"SELECT {path} AS file, {PLANTS[plant]} AS text FROM documents"


def _found(files: str, pattern: str, name: str = "found", source: str = "files") -> str:
    """CTEs of matches: (file, text, match, off, line, col, end_col), positions in code points."""
    p = pattern.replace("'", "''")
    return f"""{source} AS ({files}), {name}_z AS (
  SELECT file, text, unnest(regexp_extract_all(text, '{p}')) AS match, unnest(string_split_regex(text, '{p}')) AS gap, generate_subscripts(string_split_regex(text, '{p}'), 1) AS i FROM {source} WHERE regexp_matches(text, '{p}')
), {name}_o AS (
  SELECT *, CAST(sum(length(gap) + coalesce(length(match), 0)) OVER (PARTITION BY file ORDER BY i) AS BIGINT) - coalesce(length(match), 0) AS off FROM {name}_z
), {name} AS (
  SELECT file, text, match, off, CAST(length(text[:off]) - length(replace(text[:off], chr(10), '')) + 1 AS BIGINT) AS line, CAST(length(regexp_extract(text[:off], '[^\\n]*\\z')) + 1 AS BIGINT) AS col,
    CAST(length(regexp_extract(text[:off + length(match)], '[^\\n]*\\z')) + 1 AS BIGINT) AS end_col FROM {name}_o WHERE match IS NOT NULL
)"""


OUT = "line, column, end_column, offset, match"
SQL_OUT = 'file, line, col AS "column", end_col AS end_column, off AS "offset", match'
EM_RULE = Rule("em", ("**/*.md",), chars=(EM,))
EM_SPACED = Rule("em", ("**/*.md",), pattern=f"\\s*{EM}\\s*", fix=", ", severity="warn")
ACCENTS = Rule("accents", ("**/*.md",), pattern="é|ñ|ß")
SPACED = f"[ \\t\\n\\r]*{EM}[ \\t\\n\\r]*"


@query(f"WITH {_found(_files('em'), EM)} SELECT 'em' AS rule_id, {SQL_OUT}, 'Banned character U+2014' AS message, 'error' AS severity, false AS fixable FROM found")
def raw_findings_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(docs(spark, sf_dir, "em"), [EM_RULE]).drop("replacement")


@query(f"WITH {_found(_files('plain'), 'é|ñ|ß')} SELECT {SQL_OUT} FROM found")
def raw_findings_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(docs(spark, sf_dir, "plain"), [ACCENTS]).selectExpr("file", *OUT.split(", "))


@query(
    f"WITH {_found(_files('all'), EM, 'a')}, {_found(_files('all'), '[!' + QUOTE + ']', 'b', 'fb')}, {_found(_files('all'), NBSP, 'c', 'fc')} "
    f"SELECT 'em' AS rule_id, file, off AS \"offset\", match, 'error' AS severity FROM a UNION ALL SELECT 'marks', file, off, match, 'warn' FROM b UNION ALL SELECT 'nbsp', file, off, match, 'error' FROM c"
)
def raw_findings_multi_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [EM_RULE, Rule("marks", ("docs/**",), pattern=f"[!{QUOTE}]", severity="warn"), Rule("nbsp", ("**",), chars=(NBSP,))]
    return scan(docs(spark, sf_dir, "all"), rules).select("rule_id", "file", "offset", "match", "severity")


_U16 = "CAST(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS BIGINT)"


_LAST_LINE = "regexp_extract(text[:off], '[^\\n]*\\z')"


@query(f"WITH {_found(_files('astral'), EM)} SELECT file, line, {_U16.format('text[:off]')} AS \"offset\", {_U16.format(_LAST_LINE)} + 1 AS \"column\" FROM found")
def findings_utf16_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(docs(spark, sf_dir, "astral"), [EM_RULE]).select("file", "line", "offset", "column")


@query(f"WITH {_found(_files('crlf'), SPACED)} SELECT {SQL_OUT} FROM found")
def findings_crlf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(docs(spark, sf_dir, "crlf"), [EM_SPACED]).selectExpr("file", *OUT.split(", "))


@query(f"WITH {_found(_files('em_comma'), EM)} SELECT {SQL_OUT} FROM found")
def findings_bom_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(docs(spark, sf_dir, "bom"), [EM_RULE]).selectExpr("file", *OUT.split(", "))


@query(f"WITH {_found(_files('em_comma') + ' WHERE doc_id % 7 <> 0', EM)} SELECT {SQL_OUT} FROM found")
def binary_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").selectExpr("doc_id", f"{FILE} AS file", f"{PLANTS['em_comma']} AS text")
    # every seventh document begins like a binary file
    files = d.select("file", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("\0"), "text")).otherwise(F.col("text")).alias("text"))
    return scan(files, [EM_RULE]).selectExpr("file", *OUT.split(", "))


@query(f"WITH {_found(_files('plain'), 'eux|eu|e')} SELECT match, CAST(count(*) AS BIGINT) AS findings FROM found GROUP BY match")
def chars_longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("e", ("**/*.md",), chars=("e", "eu", "eux"))
    return scan(docs(spark, sf_dir, "plain"), [rule]).groupBy("match").agg(F.count("*").alias("findings"))


def _preset(rules: list[Rule]) -> str:
    ctes = ", ".join(_found(_files("all"), r.java.replace("|", "|"), f"p{i}", f"f{i}") for i, r in enumerate(rules))
    union = " UNION ALL ".join(f"SELECT '{r.id}' AS rule_id, file, off AS \"offset\", '{r.message}' AS message FROM p{i}" for i, r in enumerate(rules))
    return f"WITH {ctes} {union}"


@query(_preset(no_ai_punctuation(include=["**/*.md"])))
def preset_ai_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(docs(spark, sf_dir, "all"), no_ai_punctuation(include=["**/*.md"])).select("rule_id", "file", "offset", "message")


@query(_preset(invisibles(include=["**/*.md"], id_prefix="docs")))
def preset_invisibles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(docs(spark, sf_dir, "all"), invisibles(include=["**/*.md"], id_prefix="docs")).select("rule_id", "file", "offset", "message")


@query(
    f"WITH {_found(_files('all'), '[^ -~' + chr(92) + 'n]+')} SELECT match, list_aggregate(list_transform(string_split(match, ''), lambda c: 'U+' || lpad(to_base(ord(c), 16), 4, '0')), 'string_agg', ' ') AS named, CAST(count(*) AS BIGINT) AS findings FROM found GROUP BY match"
)
def default_message_codepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("odd", ("**/*.md",), pattern="[^ -~\\n]+")
    return scan(docs(spark, sf_dir, "all"), [rule]).select("match", chars.described(F.col("match")).alias("named")).groupBy("match", "named").agg(F.count("*").alias("findings"))


@query(f"WITH {_found(_files('all'), 'ß' + ZWSP + '|' + NBSP + '|' + ZWSP)} SELECT match, regexp_full_match(match, '[{NBSP}{ZWSP}]+') AS invisible, CAST(count(*) AS BIGINT) AS findings FROM found GROUP BY match")
def invisible_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("odd", ("**/*.md",), chars=("ß" + ZWSP, NBSP, ZWSP))
    return scan(docs(spark, sf_dir, "all"), [rule]).groupBy("match").agg(F.count("*").alias("findings")).withColumn("invisible", chars.invisible(F.col("match")))


MIXED = [EM_SPACED, Rule("marks", ("**/*.md",), chars=("!", "|"))]
_MIXED = f"{_found(_files(), SPACED, 'a')}, {_found(_files(), '!|[|]', 'b', 'fb')}, mixed AS (SELECT 'em' AS rule_id, file, off, 'warn' AS severity, true AS fixable FROM a UNION ALL SELECT 'marks', file, off, 'error', false FROM b)"


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(docs(spark, sf_dir), MIXED)


@query(f"WITH {_MIXED} SELECT CAST(count(*) FILTER (severity = 'error') AS BIGINT) AS errors, CAST(count(*) FILTER (severity <> 'error') AS BIGINT) AS warnings, CAST(count(*) FILTER (fixable) AS BIGINT) AS fixable, CAST(count(DISTINCT file) AS BIGINT) AS files FROM mixed")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(_mixed(spark, sf_dir))


@query(f"WITH {_MIXED} SELECT severity, CAST(count(*) AS BIGINT) AS findings FROM mixed GROUP BY severity")
def summary_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("findings"))


@query(f"WITH {_MIXED} SELECT file, CAST(count(*) AS BIGINT) AS findings, min(off) AS first FROM mixed GROUP BY file")
def findings_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = report.by_file(_mixed(spark, sf_dir))
    return grouped.select("file", F.size("findings").cast("long").alias("findings"), F.element_at("findings", 1)["offset"].alias("first"))


@query(f"WITH {_MIXED} SELECT rule_id, CAST(count(*) AS BIGINT) AS findings, CAST(count(DISTINCT file) AS BIGINT) AS files FROM mixed GROUP BY rule_id")
def findings_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("findings"), F.count_distinct("file").alias("files"))


@query(f"WITH {_MIXED} SELECT DISTINCT file FROM mixed")
def files_with_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).select("file").distinct()


@query(f"WITH {_MIXED} SELECT rule_id, severity, CAST(count(*) AS BIGINT) AS findings FROM mixed GROUP BY ROLLUP (rule_id, severity)")
def rollup_rule_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).rollup("rule_id", "severity").agg(F.count("*").alias("findings"))


@query(
    f"WITH {_found(_files(), EM)} SELECT l.quality, l.toxic, CAST(count(f.off) AS BIGINT) AS findings, CAST(count(DISTINCT l.doc_id) AS BIGINT) AS docs FROM labels l LEFT JOIN found f ON CAST(regexp_extract(f.file, '([0-9]+)[.]md', 1) AS BIGINT) = l.doc_id GROUP BY ALL"
)
def findings_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(docs(spark, sf_dir), [EM_RULE]).select(F.regexp_extract("file", "([0-9]+)[.]md", 1).cast("long").alias("doc_id"), "offset")
    return _table(spark, sf_dir, "labels").join(found, "doc_id", "left").groupBy("quality", "toxic").agg(F.count("offset").alias("findings"), F.count_distinct("doc_id").alias("docs"))


# plans

TREE = "concat(CASE doc_id % 6 WHEN 0 THEN 'docs/' WHEN 1 THEN 'src/app/' WHEN 2 THEN 'node_modules/x/' WHEN 3 THEN '.github/' WHEN 4 THEN 'src/.git/' ELSE '' END, doc_id, CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.ts' WHEN 2 THEN '.html' ELSE '.txt' END)"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "plain", TREE)


_PATHS = f"paths AS (SELECT {TREE} AS file FROM documents)"


@query(f"WITH {_PATHS} SELECT file, 'a' AS rule_id FROM paths WHERE regexp_full_match(file, '(docs|src)/([^./][^/]*/)*[^./][^/]*[.](md|ts)') AND NOT regexp_full_match(file, 'src/app/[^/]*1[.]ts') UNION ALL SELECT file, 'b' FROM paths WHERE regexp_full_match(file, '[^./][^/]*[.]txt')")
def plan_glob_include_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [Rule("a", ("docs/**/*.{md,ts}", "src/**/*.{md,ts}"), chars=("x",), exclude=("src/app/*1.ts",)), Rule("b", ("*.txt",), chars=("x",))]
    return plan(_tree(spark, sf_dir), rules).select("file", "rule_id")


@query(f"WITH {_PATHS} SELECT file FROM paths WHERE NOT starts_with(file, 'node_modules/') AND NOT starts_with(file, '.') AND NOT starts_with(file, 'src/.')")
def plan_default_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(_tree(spark, sf_dir), [Rule("all", ("**",), chars=("x",))]).select("file")


@query(f"WITH {_PATHS} SELECT file, 'named' AS rule_id FROM paths WHERE starts_with(file, '.github/')")
def plan_dot_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [Rule("named", (".github/**",), chars=("x",)), Rule("star", ("*/.git/**", "*github/**"), chars=("x",))]
    return plan(_tree(spark, sf_dir), rules).select("file", "rule_id")


_COUNTS = f"""WITH {_PATHS}, seen AS (SELECT file FROM paths WHERE NOT starts_with(file, 'node_modules/') AND NOT starts_with(file, '.') AND NOT starts_with(file, 'src/.')),
counts AS (SELECT 'raw' AS rule_id, CAST(count(*) AS BIGINT) AS matched, CAST(0 AS BIGINT) AS unreadable FROM seen
UNION ALL SELECT 'md', count(*), count(*) FILTER (NOT ends_with(file, '.md')) FROM seen
UNION ALL SELECT 'vue', count(*), count(*) FROM seen WHERE starts_with(file, 'docs/')
UNION ALL SELECT 'none', 0, 0)
SELECT *, CASE WHEN matched = 0 THEN 'no files' WHEN matched = unreadable THEN 'unreadable scope' ELSE 'ok' END AS status FROM counts"""
_COUNTED = [Rule("raw", ("**",), chars=("x",)), Rule("md", ("**",), chars=("x",), scope="markdown"), Rule("vue", ("docs/**",), chars=("x",), scope="markup"), Rule("none", ("nowhere/**",), chars=("x",))]


@query(_COUNTS)
def plan_rule_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_counts(_tree(spark, sf_dir), _COUNTED)


@query(f"SELECT rule_id FROM ({_COUNTS}) WHERE status = 'no files'")
def plan_zero_match_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_counts(_tree(spark, sf_dir), _COUNTED).filter("status = 'no files'").select("rule_id")


@query(f"SELECT rule_id, matched FROM ({_COUNTS}) WHERE status = 'unreadable scope'")
def plan_unreadable_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_counts(_tree(spark, sf_dir), _COUNTED).filter("status = 'unreadable scope'").select("rule_id", "matched")


@query(f"WITH {_PATHS}, wanted AS (SELECT concat('docs/', doc_id, '.md') AS file FROM labels WHERE toxic = 0) SELECT file, 'all' AS rule_id FROM paths WHERE file IN (SELECT file FROM wanted)")
def plan_restriction(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _table(spark, sf_dir, "labels").filter("toxic = 0").selectExpr("concat('docs/', doc_id, '.md') AS file")
    return plan(_tree(spark, sf_dir), [Rule("all", ("**",), chars=("x",))], paths=wanted).select("file", "rule_id")


@query(f"""WITH {_PATHS}, named AS (
  SELECT row_number() OVER (ORDER BY p COLLATE "C") AS r, string_split(p, '/') AS parts FROM (SELECT DISTINCT regexp_replace(file, '[0-9]+', '*') AS p FROM paths)
), segments AS (SELECT r, parts, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS part, len(parts) AS many FROM named
), words AS (SELECT *, regexp_extract(part, '^[.]?([^.*]*)', 1) AS word FROM segments
), numbers AS (SELECT word, row_number() OVER (ORDER BY min(r * 100 + i)) AS n, arg_min(CASE WHEN i = many THEN 'file' ELSE 'dir' END, r * 100 + i) AS kind FROM words WHERE word <> '' GROUP BY word)
SELECT array_to_string(any_value(parts), '/') AS pattern, string_agg(CASE WHEN w.word = '' THEN part ELSE replace(part, w.word, kind || n) END, '/' ORDER BY i) AS hidden FROM words w LEFT JOIN numbers ON w.word = numbers.word GROUP BY r""")
def anonymize_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hide = globs.anonymizer()
    patterns = [r["p"] for r in _tree(spark, sf_dir).selectExpr("regexp_replace(file, '[0-9]+', '*') AS p").distinct().orderBy("p").collect()]
    return spark.createDataFrame([(p, hide(p)) for p in patterns], "pattern string, hidden string")


@query(f"WITH {_PATHS} SELECT DISTINCT regexp_replace(file, '[0-9]+', '*') AS pattern, regexp_extract(file, '[.][a-z]+$') AS extension FROM paths")
def glob_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = [r["p"] for r in _tree(spark, sf_dir).selectExpr("regexp_replace(file, '[0-9]+', '*') AS p").distinct().collect()]
    return spark.createDataFrame([(p, e) for p in patterns for e in globs.extensions(p) or ()], "pattern string, extension string")


# suppressions


@query(f"WITH {_found(_files('line'), EM)} SELECT file, line, off AS \"offset\" FROM found WHERE NOT contains(string_split(text, chr(10))[line], '{MARKER}-disable-line')")
def suppress_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(docs(spark, sf_dir, "line"), [EM_RULE]).select("file", "line", "offset")


@query(f"WITH {_found(_files('next'), EM)} SELECT file, line, off AS \"offset\" FROM found WHERE line = 1 OR NOT contains(string_split(text, chr(10))[line - 1], '{MARKER}-disable-next-line')")
def suppress_next_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(docs(spark, sf_dir, "next"), [EM_RULE]).select("file", "line", "offset")


_FILE_RULES = [EM_RULE, Rule("other", ("**",), chars=("!",))]
_FILE_SQL = f"WITH {_found(_files('file'), EM, 'a')}, {_found(_files('file'), '!', 'b', 'fb')} SELECT 'em' AS rule_id, file, off AS \"offset\" FROM a WHERE NOT regexp_matches(text, '{MARKER}-disable-file( em)?\\z') UNION ALL SELECT 'other', file, off FROM b WHERE NOT regexp_matches(text, '{MARKER}-disable-file( other)?\\z')"


@query(_FILE_SQL)
def suppress_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(docs(spark, sf_dir, "file"), _FILE_RULES).select("rule_id", "file", "offset")


@query(_FILE_SQL)
def suppress_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the table of suppressions: findings of a scan that knows another marker, less those that it holds for."""
    files = docs(spark, sf_dir, "file")
    return without_suppressed(scan(files, _FILE_RULES, marker="another"), suppressions(files)).select("rule_id", "file", "offset")


@query(f"SELECT {FILE} AS file, 'file' AS kind, CAST(NULL AS BIGINT) AS line, CASE doc_id % 5 WHEN 1 THEN 'em' WHEN 2 THEN 'other' END AS rule_id FROM documents WHERE doc_id % 5 < 3 AND text IS NOT NULL")
def suppress_named_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppressions(docs(spark, sf_dir, "file"))


@query(f"WITH {_found(_files('fence'), EM)} SELECT file, line, off AS \"offset\" FROM found")
def suppress_markdown_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(docs(spark, sf_dir, "fence"), [EM_RULE]).select("file", "line", "offset")


# messages

_MESSAGE = "concat(CASE turn % 3 WHEN 1 THEN 'Merge of ' WHEN 2 THEN '# note, first\n' ELSE '' END, replace(text, '. ', '.\n# ' ), '\n# ------------------------ >8 ------------------------\nno, not this')"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _table(spark, sf_dir, "conversations").selectExpr("concat(conv_id, '-', turn) AS file", f"{_MESSAGE} AS text")
    return messages.prepared(made)


_BLANKED = f"""made AS (SELECT concat(conv_id, '-', turn) AS file, {_MESSAGE} AS text FROM conversations), lines AS (SELECT file, string_split(text, chr(10)) AS l, text FROM made),
masked AS (SELECT file, regexp_matches(list_filter(l, lambda x: x <> '' AND NOT starts_with(x, '#'))[1], '^Merge') AS generated, text,
 list_aggregate(list_transform(l, lambda x, i: CASE WHEN starts_with(x, '#') OR i = len(l) THEN repeat(' ', length(x)) ELSE x END), 'string_agg', chr(10)) AS m FROM lines),
prepared AS (SELECT file, generated, CASE WHEN generated THEN regexp_replace(text, '[^\\r\\n]', ' ', 'g') ELSE m END AS text FROM masked)"""


@query(f"WITH {_BLANKED} SELECT file, text, generated FROM prepared")
def commit_msg_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("file", "text", "generated")


@query(f"WITH {_BLANKED} SELECT generated, CAST(count(*) AS BIGINT) AS messages FROM prepared GROUP BY generated")
def commit_msg_generated_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).groupBy("generated").agg(F.count("*").alias("messages"))


@query(f"WITH {_BLANKED}, {_found('SELECT file, text FROM prepared WHERE NOT generated', ',')} SELECT file, line, off AS \"offset\" FROM found")
def commit_msg_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _messages(spark, sf_dir).filter("not generated").select("file", "text")
    return scan(files, [Rule("comma", ("**",), chars=(",",))], assume_text=True).select("file", "line", "offset")


# fixes

FIXED = Rule("em", ("**/*.md",), pattern=f" {EM} ", fix=", ")


@query(f"SELECT file, replace(text, ' {EM} ', ', ') AS text, CAST((length(text) - length(replace(text, ' {EM} ', ''))) // 3 AS INTEGER) AS fixed FROM ({_files()}) WHERE contains(text, ' {EM} ')")
def fix_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = docs(spark, sf_dir)
    return fix.fixed(files, [FIXED]).select("file", "text", "fixed")


@query(f"SELECT file, replace(text, ' {EM} ', ', ') AS text FROM ({_files()}) WHERE contains(text, ' {EM} ')")
def fix_string_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without leaving Spark's expressions: spans and fold in one projection."""
    found = F.transform(spans(F.col("text"), FIXED.java, F.lit(False)), lambda s: F.struct(s["cp_offset"].alias("at"), s["match"].alias("match"), F.lit(FIXED.fix).alias("replacement")))
    return docs(spark, sf_dir).filter(F.col("text").rlike(FIXED.java)).select("file", fix.folded(F.col("text"), found)["text"].alias("text"))


@query(f"SELECT file, CAST((length(text) - length(replace(text, ' {EM} ', ''))) // 3 AS INTEGER) AS fixed, CAST((length(text) - length(replace(text, ' {EM} ', ''))) // 3 AS INTEGER) AS overlap, CAST(0 AS INTEGER) AS stale FROM ({_files()}) WHERE contains(text, ' {EM} ')")
def fix_overlap_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules want each dash: the one that begins later wins."""
    files = docs(spark, sf_dir)
    rules = [Rule("wide", ("**/*.md",), pattern=f" {EM} ", fix=", "), Rule("narrow", ("**/*.md",), chars=(EM,), fix="-")]
    return fix.fixed(files, rules).select("file", "fixed", "overlap", "stale")


@query(f"SELECT file, CAST(0 AS INTEGER) AS fixed, CAST((length(text) - length(replace(text, ' {EM} ', ''))) // 3 AS INTEGER) AS stale FROM ({_files()}) WHERE contains(text, ' {EM} ')")
def fix_stale_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts changed after the scan: no match is where it was."""
    files = docs(spark, sf_dir)
    changed = files.select("file", F.translate("text", EM, "+").alias("text"))
    return fix.fixed_files(changed, scan(files, [FIXED])).select("file", "fixed", "stale")


@query(f"SELECT CAST(sum((length(text) - length(replace(text, ' {EM} ', ''))) // 3) AS BIGINT) AS fixed, CAST(count(*) AS BIGINT) AS files FROM ({_files()}) WHERE contains(text, ' {EM} ')")
def fix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = docs(spark, sf_dir)
    return fix.fixed(files, [FIXED]).agg(F.sum("fixed").alias("fixed"), F.count("*").alias("files"))


@query(f"SELECT file, replace(replace(text, '{EM}', '{EN}'), '{EN}', '-') AS text FROM ({_files()})")
def fix_fixpoint_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [Rule("em", ("**/*.md",), chars=(EM,), fix=EN), Rule("en", ("**/*.md",), chars=(EN,), fix="-")]
    return fix.fix_to_fixpoint(docs(spark, sf_dir), rules).files


@query(f"SELECT CAST(10 * sum(length(text) - length(replace(text, '{EM}', ''))) AS BIGINT) AS fixed, false AS converged FROM ({_files()})")
def fix_oscillation_not_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [Rule("em", ("**/*.md",), chars=(EM,), fix=EN), Rule("en", ("**/*.md",), chars=(EN,), fix=EM)]
    done = fix.fix_to_fixpoint(docs(spark, sf_dir), rules)
    return spark.createDataFrame([(done.fixed, done.converged)], "fixed long, converged boolean")


CLAUSES = Rule("dash", ("**/*.md",), pattern=f"\\s*{EM}\\s*", fix=clause_separator)


# sentences with their places: a sign that no text has goes where one begins
_WS = "[ \\t\\r\\f\\v\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
_SENTENCES = f"""lines AS (
  SELECT file, text, string_split(text, chr(10)) AS l FROM files WHERE contains(text, '{EM}')
), marked AS (
  SELECT file, text, list_aggregate(list_transform(l, lambda x, i: CASE WHEN i > 1 AND (regexp_matches(x, '^{_WS}*(<|([-*+>|]|[0-9]+[.)]|#{{1,6}}){_WS})') OR regexp_matches(l[i - 1], '^{_WS}*(#{{1,6}}{_WS}|$)')) THEN chr(1) ELSE '' END
    || regexp_replace(x, '([.!?;]["''`)\\]]*{_WS})', '\\1' || chr(1), 'g')), 'string_agg', chr(10)) AS m FROM lines
), cut AS (
  SELECT file, text, unnest(string_split(m, chr(1))) AS raw, generate_subscripts(string_split(m, chr(1)), 1) AS nth FROM marked
), sentences AS (
  SELECT file, nth, raw, regexp_replace(regexp_replace(raw, '^({_WS}|\\n)+', ''), '({_WS}|\\n)+$', '') AS sentence, CAST(sum(length(raw)) OVER (PARTITION BY file ORDER BY nth) AS BIGINT) - length(raw) AS begins FROM cut
)"""


@query(
    f"""WITH {_found(_files('em'), SPACED)}, {_SENTENCES}, held AS (
  SELECT f.file, f.off, f.match, s.sentence AS c, f.off - s.begins - (length(s.raw) - length(regexp_replace(s.raw, '^({_WS}|\\n)+', ''))) AS pos FROM found f JOIN sentences s ON f.file = s.file AND f.off >= s.begins AND f.off < s.begins + length(s.raw)
), split AS (
  SELECT *, length(c) - length(replace(c, '{EM}', '')) AS dashes, substr(c, 1, pos) AS before, substr(c, pos + length(match) + 1) AS after, string_split(c, '{EM}') AS parts, regexp_extract(match, '{EM}(.*)$', 1, 's') AS right_side, regexp_extract(match, '^(.*){EM}', 1, 's') AS left_side FROM held
), signed AS (
  SELECT *, CASE WHEN dashes = 2 AND NOT regexp_matches(parts[2], '[.!?]({_WS}|\\n)') AND contains(substr(c, pos + 1, length(match)), '{EM}') THEN CASE WHEN contains(before, '{EM}') THEN ')' ELSE '(' END
    WHEN regexp_matches(after, '^({_WS}|\\n)*(?i:and|but|or|nor|so|yet|then|because)([^A-Za-z0-9_]|$)') THEN ',' WHEN dashes > 1 OR contains(before, ':') THEN ',' ELSE ':' END AS mark FROM split
), ended AS (
  SELECT *, CASE WHEN contains(right_side, chr(10)) THEN right_side WHEN contains(left_side, chr(10)) THEN left_side END AS side FROM signed
)
SELECT file, off AS "offset", match, CASE WHEN side IS NOT NULL THEN CASE WHEN mark = '(' THEN regexp_extract(side, '\\r?\\n.*', 0, 's') || mark ELSE mark || regexp_extract(side, '\\r?\\n.*', 0, 's') END
  WHEN mark = '(' THEN CASE WHEN pos = 0 THEN '(' ELSE ' (' END WHEN after = '' OR regexp_matches(after, '^[.,;:!?)\\]}}\\n]') THEN mark ELSE mark || ' ' END AS replacement FROM ended"""
)
def clause_separator_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(docs(spark, sf_dir, "em"), [CLAUSES]).select("file", "offset", "match", "replacement")


@query(f"WITH {_found(_files('em'), EM)}, {_SENTENCES} SELECT f.file, f.off AS \"offset\", s.sentence FROM found f JOIN sentences s ON f.file = s.file AND f.off >= s.begins AND f.off < s.begins + length(s.raw)")
def sentence_of_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("dash", ("**/*.md",), chars=(EM,), fix=lambda c: c.container)
    return scan(docs(spark, sf_dir, "em"), [rule]).select("file", "offset", F.col("replacement").alias("sentence"))


# baseline

_HASH = "substr(sha256(regexp_replace(regexp_replace(substr(text, greatest(off - 40, 0) + 1, off + length(match) + 40 - greatest(off - 40, 0)), '[ \\t\\n\\r]+', ' ', 'g'), '^ | $', '', 'g')), 1, 12)"
_KEYED = f"{_found(_files(), EM)}, keyed AS (SELECT file, off, {_HASH} AS context FROM found), ranked AS (SELECT file, off, context, CAST(row_number() OVER (PARTITION BY file, context ORDER BY off) - 1 AS INTEGER) AS ordinal FROM keyed)"


def _em_findings(spark: SparkSession, sf_dir: str, again: bool = False) -> tuple[DataFrame, DataFrame]:
    """again: the findings are read more than once, so the texts are scanned for a table."""
    files = docs(spark, sf_dir)
    found = scan(files, [EM_RULE], internal=True)
    return files, kept(found) if again else found


@query(f"WITH {_KEYED} SELECT file, off AS \"offset\", context FROM ranked")
def baseline_context_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, found = _em_findings(spark, sf_dir)
    return baseline.keyed(found).select("file", "offset", "context")


@query(f"WITH {_KEYED} SELECT file, off AS \"offset\", ordinal FROM ranked")
def baseline_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, found = _em_findings(spark, sf_dir)
    return baseline.keyed(found).select("file", "offset", F.col("ordinal").cast("int").alias("ordinal"))


@query(f"WITH {_KEYED} SELECT file, 'em' AS rule_id, context, ordinal FROM ranked")
def baseline_entries_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, found = _em_findings(spark, sf_dir)
    return baseline.entries_for(found).orderBy("file", "rule_id", "context", "ordinal")


def _recorded(found: DataFrame, keep: str) -> DataFrame:
    """A baseline of the findings for which ``keep`` holds; pos by offset."""
    own = baseline.keyed(found).filter(keep)
    return own.select("file", "rule_id", "context", F.col("ordinal").cast("int").alias("ordinal"), F.col("offset").cast("int").alias("pos"))


@query(f"WITH {_KEYED} SELECT 'baselined' AS part, CAST(count(*) AS BIGINT) AS n FROM ranked WHERE off % 2 = 0 UNION ALL SELECT 'reported', count(*) FROM ranked WHERE off % 2 = 1 UNION ALL SELECT 'stale', 0")
def baseline_partition_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, found = _em_findings(spark, sf_dir, again=True)
    parts = baseline.split(found, _recorded(found, "offset % 2 = 0"))
    counts = [df.agg(F.lit(n).alias("part"), F.count("*").alias("n")) for n, df in (("baselined", parts.baselined), ("reported", parts.reported), ("stale", parts.stale))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(f"WITH {_found(_files(), EM)}, n AS (SELECT file, off, row_number() OVER (PARTITION BY file ORDER BY off) AS k, count(*) FILTER (off % 2 = 0) OVER (PARTITION BY file) AS known FROM found) SELECT file, off AS \"offset\", k > known AS reported FROM n")
def baseline_partition_count_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every context has changed: as many findings of a file are known as it has entries, the first ones."""
    files, found = _em_findings(spark, sf_dir, again=True)
    old = _recorded(found, "offset % 2 = 0").withColumn("context", F.lit("gone"))
    parts = baseline.split(found, old)
    return parts.baselined.select("file", "offset", F.lit(False).alias("reported")).unionByName(parts.reported.select("file", "offset", F.lit(True).alias("reported")))


@query(f"WITH {_KEYED} SELECT file, context, ordinal FROM ranked")
def baseline_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, found = _em_findings(spark, sf_dir)
    cleaned = files.select("file", F.translate("text", EM, "-").alias("text"))
    parts = baseline.split(scan(cleaned, [EM_RULE], internal=True), _recorded(found, "true"))
    return parts.stale.select("file", "context", "ordinal")


@query(f"WITH {_KEYED} SELECT file, context, ordinal FROM ranked WHERE starts_with(file, 'docs/de/')")
def baseline_scope_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, found = _em_findings(spark, sf_dir)
    cleaned = files.select("file", F.translate("text", EM, "-").alias("text"))
    parts = baseline.split(scan(cleaned, [EM_RULE], internal=True), _recorded(found, "true"), files.filter("file like 'docs/de/%'").select("file"))
    return parts.stale.select("file", "context", "ordinal")


@query(f"WITH {_KEYED} SELECT file, context, ordinal FROM ranked WHERE off % 2 = 0 OR NOT starts_with(file, 'docs/de/')")
def baseline_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a run over the German files that left every other finding there."""
    files, found = _em_findings(spark, sf_dir, again=True)
    german = files.filter("file like 'docs/de/%'").select("file")
    kept = found.filter("file like 'docs/de/%' AND offset % 2 = 0")
    rest = baseline.keyed(found).filter("file like 'docs/de/%' AND offset % 2 = 0")
    old = _recorded(found, "true")
    new = baseline.pruned(old, kept, german)
    # ordinals of what is left are counted anew, as in a scan of the new texts
    return new.join(german, "file", "left_anti").unionByName(rest.select("file", "rule_id", "context", "ordinal")).select("file", "context", F.col("ordinal").cast("int").alias("ordinal"))


# reports


@query(f"WITH {_found(_files(), EM)} SELECT file, off AS \"offset\", string_split(text, chr(10))[line] AS excerpt, repeat(' ', col - 1) || '^' AS caret FROM found")
def excerpt_caret(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = docs(spark, sf_dir)
    return report.with_caret(scan(files, [EM_RULE], excerpts=True)).select("file", "offset", "excerpt", "caret")


@query(
    f"WITH {_found(_files(), EM)} SELECT file, off AS \"offset\", '{{\"ruleId\":\"em\",\"file\":\"' || file || '\",\"line\":' || line || ',\"column\":' || col || ',\"endColumn\":' || end_col || ',\"offset\":' || off || ',\"match\":\"{EM}\",\"message\":\"Banned character U+2014\",\"severity\":\"error\",\"fixable\":false}}' AS json FROM found"
)
def report_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.json_rows(scan(docs(spark, sf_dir), [EM_RULE])).select("file", "offset", "json")


@query(f"WITH {_found(_files(), EM)} SELECT 'em' AS rule_id, 'error' AS level, 'Banned character U+2014' AS message, file AS uri, line AS start_line, col AS start_column, end_col AS end_column FROM found")
def report_sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sarif_results(scan(docs(spark, sf_dir), [EM_RULE])).drop("offset")


@query(f"WITH {_found(_files('plain'), 'é|ñ|ß')} SELECT 'accents' AS rule_id, 'Banned character U+' || lpad(to_base(ord(arg_min(match, (file, off))), 16), 4, '0') AS message FROM found")
def sarif_rules_first_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sarif_rules(scan(docs(spark, sf_dir, "plain"), [ACCENTS])).select("rule_id", "message")


@query(f"WITH {_MIXED} SELECT rule_id, file, off AS \"offset\" FROM mixed WHERE severity = 'error'")
def quiet_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.listed(_mixed(spark, sf_dir), quiet=True).select("rule_id", "file", "offset")


_CODE = f"WITH {_MIXED}, s AS (SELECT count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity <> 'error') AS w FROM mixed)"


@query(f"{_CODE} SELECT CAST(CASE WHEN e > 0 THEN 1 ELSE 0 END AS INTEGER) AS code FROM s")
def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(_mixed(spark, sf_dir)).select(report.exit_code(F.col("errors"), F.col("warnings")).alias("code"))


@query(f"{_CODE} SELECT CAST(CASE WHEN w > 10 THEN 1 ELSE 0 END AS INTEGER) AS over_ten, CAST(CASE WHEN w > 1000000 THEN 1 ELSE 0 END AS INTEGER) AS over_million FROM s")
def max_warnings_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = report.summary(_mixed(spark, sf_dir))
    return s.select(report.exit_code(F.lit(0), F.col("warnings"), max_warnings=10).alias("over_ten"), report.exit_code(F.lit(0), F.col("warnings"), max_warnings=1_000_000).alias("over_million"))


# scopes

_HTML_FILE = "concat('pages/', page_id, '.html')"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").selectExpr(f"{_HTML_FILE} AS file", "html AS text")


_VISIBLE = f"SELECT {_HTML_FILE} AS file, regexp_replace(regexp_replace(html, '(?s)<script>.*?</script>|<style>.*?</style>|<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g') AS text FROM pages"


@query(f"SELECT file, CAST(length(regexp_replace(text, '[^é,.&]', '', 'g')) AS BIGINT) AS findings FROM ({_VISIBLE}) WHERE regexp_matches(text, '[é,.&]')")
def html_text_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("signs", ("**/*.html",), pattern="[é,.&]", scope="html")
    return scan(_pages(spark, sf_dir), [rule]).groupBy("file").agg(F.count("*").alias("findings"))


@query(f"SELECT file, CAST(length(regexp_replace(text, '[^;{{}}]', '', 'g')) AS BIGINT) AS findings FROM ({_VISIBLE}) WHERE regexp_matches(text, '[;{{}}]')")
def html_skip_script_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("code", ("**/*.html",), pattern="[;{}]", scope="html")
    return scan(_pages(spark, sf_dir), [rule]).groupBy("file").agg(F.count("*").alias("findings"))


@query(f"SELECT {_HTML_FILE} AS file, CAST(list_sum(list_transform(regexp_extract_all(html, ' href=\"([^\"]*)\"', 1), lambda h: length(h) - length(replace(h, '/', '')))) AS BIGINT) AS findings FROM pages WHERE contains(html, ' href=\"')")
def html_attr_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    slash = Rule("slash", ("**/*.html",), chars=("/",), scope="html")
    found = scan(_pages(spark, sf_dir), [slash], text_attributes=["href"])
    plain = scan(_pages(spark, sf_dir), [slash], text_attributes=[])
    return found.join(plain, ["file", "offset"], "left_anti").groupBy("file").agg(F.count("*").alias("findings"))


@query(f"SELECT {_HTML_FILE} AS file, CAST(2 * len(regexp_extract_all(html, 'var t=\"')) AS BIGINT) AS findings FROM pages WHERE contains(html, 'var t=\"')")
def html_script_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of strings in scripts; those in text don't follow an equals sign."""
    rule = Rule("quote", ("**/*.html",), pattern='(?<==)"|"(?=;track)', scope="html")
    return scan(_pages(spark, sf_dir), [rule], text_attributes=[]).groupBy("file").agg(F.count("*").alias("findings"))


@query(f"WITH {_found(_files('em'), SPACED)} SELECT file, off AS \"offset\", match FROM found")
def markdown_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(docs(spark, sf_dir, "em"), [Rule("em", ("**/*.md",), pattern=f"\\s*{EM}\\s*", scope="markdown")]).select("file", "offset", "match")


def _wrapped(before: Column, after: Column, ending: str) -> Callable[[SparkSession, str], DataFrame]:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = docs(spark, sf_dir)
        return d.select(F.regexp_replace("file", "\\.md$", ending).alias("file"), F.concat(before, F.regexp_replace("text", "[\"`\\\\\\n$<>{}]", " "), after).alias("text"))

    return make


_CLEAN = "regexp_replace(text, '[\"`\\\\\\n$<>{}]', ' ', 'g')"


@query(f"WITH {_found('SELECT regexp_replace(file, ' + repr('[.]md$') + ', ' + repr('.ts') + ') AS file, ' + repr('const a = b / c; // x') + ' || ' + repr(' ' + EM) + ' || chr(10) || ' + repr('let t = ') + ' || chr(34) || ' + _CLEAN + ' || chr(34) AS text FROM (' + _files() + ')', EM)} SELECT file, line, off AS \"offset\" FROM found WHERE line = 2")
def strings_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _wrapped(F.lit(f'const a = b / c; // x {EM}\nlet t = "'), F.lit('"'), ".ts")(spark, sf_dir)
    return scan(files, [Rule("em", ("**/*.ts",), chars=(EM,), scope="strings")]).select("file", "line", "offset")


@query(f"WITH {_found('SELECT regexp_replace(file, ' + repr('[.]md$') + ', ' + repr('.vue') + ') AS file, ' + repr('<!-- ' + EM + ' -->') + ' || chr(10) || ' + repr('<template><p>') + ' || ' + _CLEAN + ' || ' + repr('</p></template>') + ' AS text FROM (' + _files() + ')', EM)} SELECT file, line, off AS \"offset\" FROM found WHERE line = 2")
def markup_vue(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _wrapped(F.lit(f"<!-- {EM} -->\n<template><p>"), F.lit("</p></template>"), ".vue")(spark, sf_dir)
    return scan(files, [Rule("em", ("**/*.vue",), chars=(EM,), scope="markup")]).select("file", "line", "offset")


@query(f"WITH staged AS (SELECT {FILE} AS file FROM documents JOIN labels USING (doc_id) WHERE quality = 1), {_found(_files() + ' WHERE ' + FILE + ' IN (SELECT file FROM staged)', EM)} SELECT file, off AS \"offset\" FROM found")
def staged_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of the files that another table names."""
    staged = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id", "left_semi").selectExpr(f"{FILE} AS file")
    return scan(docs(spark, sf_dir), [EM_RULE], paths=staged).select("file", "offset")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST({c} AS INTEGER), '{k}', {str(h).lower()})" for n, (c, k, h) in chars.CATALOG.items()) + ") t(name, code_point, category, invisible)")
def char_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chars.catalog(spark).drop("ch")
