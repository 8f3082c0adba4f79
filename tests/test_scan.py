"""The scan: positions, suppressions and fixes, in both of its ways."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphsieve.functions.chars import BOM
from glyphsieve.functions.sentences import clause_separator
from glyphsieve.functions.text import context_of, is_plain
from glyphsieve.operators import baseline, batchscan, fix, messages, report
from glyphsieve.operators.scan import FINDINGS, is_native, ordered, scan, skipped
from glyphsieve.operators.suppress import suppressions, without_suppressed
from glyphsieve.operators.textscan import scan_text
from glyphsieve.plans.planner import plan, rule_counts, warnings
from glyphsieve.plans.rules import Rule

D, R = "\u2014", "\U0001f680"
EM = Rule("em", ("**",), chars=(D,))
FILES = "file string, text string"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"first\nsecond {D} here\n", (2, 8, 9)),
        (f"first\r\nsecond\r\nthird {D}\r\n", (3, 7, 8)),
        (f"x{R}{D}", (1, 4, 5)),
        (f"\ufeff{D} start", (1, 1, 2)),
    ],
)
def test_positions(text, want):
    [f] = scan_text(text, "a.md", [EM])
    assert (f["line"], f["column"], f["end_column"]) == want


def test_degenerate_texts():
    assert scan_text("", "a", [EM]) == []
    assert scan_text("\ufeff", "a", [EM]) == []
    assert scan_text(f"\0{D}", "a", [EM]) == []
    assert len(scan_text(f"\0{D}", "a", [EM], assume_text=True)) == 1
    assert scan_text(D, "a", []) == []
    assert scan_text("aaa", "a", [Rule("r", ("**",), pattern="x*")]) == []
    assert [f["match"] for f in scan_text("axxa", "a", [Rule("r", ("**",), pattern="x*")])] == ["xx"]


SILENT = [
    (f"{D} // glyphsieve-disable-line", []),
    (f"{D} // glyphsieve-disable-line em", []),
    (f"{D} // glyphsieve-disable-line other", [1]),
    (f"{D} <!-- glyphsieve-disable-line -->", []),
    (f"{D} /* glyphsieve-disable-line other */", [1]),
    (f"// glyphsieve-disable-line (reason)\n{D}", [2]),
    (f"// glyphsieve-disable-next-line em (why)\n{D}\n{D}", [3]),
    (f"{D}\n{D}\n# glyphsieve-disable-file", []),
    (f"{D}\n# glyphsieve-disable-file other em", []),
    (f"{D}\n# glyphsieve-disable-file other", [1]),
]


@pytest.mark.parametrize(("text", "want"), SILENT)
def test_suppressions(text, want):
    assert [f["line"] for f in scan_text(text, "a.js", [EM])] == want


def test_examples_in_fences_suppress_nothing():
    text = f"```\nglyphsieve-disable-file\n```\n{D}"
    assert len(scan_text(text, "a.md", [EM])) == 1
    assert scan_text(text, "a.txt", [EM]) == []
    assert scan_text(text.replace("glyphsieve", "mine"), "a.txt", [EM], marker="mine") == []


def corpus():
    rng = random.Random(3)
    parts = [D, "\u2015", " ", "  ", "\n", "\r\n", "word", "and", ".", ": ", R, "\u00a0", "`x`", "glyphsieve-disable-line em\n", "glyphsieve-disable-next-line\n", "```\n", "\u200b", "<p>", "'s'", "{", "}"]
    rows = [(f"d{i % 3}/f{i}.{rng.choice(['md', 'txt', 'html', 'ts', 'vue'])}", "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    return [*rows, ("nul.md", f"\0{D}"), ("bom.md", f"\ufeff{D}\n{D}"), ("none.md", None), (None, D), ("empty.md", "")]


RULES = [
    EM,
    Rule("spaced", ("**/*.{md,txt}",), pattern=f"\\s*[{D}\u2015]\\s*", fix=" - ", severity="warn"),
    Rule("odd", ("d1/**", "*.md"), chars=("\u200b", "\u00a0", R, f"{D}\n"), message="odd"),
    Rule("cut", ("**",), pattern="\\n+\\s*\\w", exclude=("d2/**",)),
]


@pytest.mark.parametrize("native", [True, False])
def test_spark_scan_is_the_python_scan(spark, native):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "file string, text string, rule_id int, wide string")
    got = [r.asDict() for r in ordered(scan(df, RULES, native=native)).collect()]
    want = []
    for file, text in rows:
        if file is not None and text is not None:
            rules = [r for r in RULES if applies(r, file)]
            want += [{k: v for k, v in f.items() if k != "cp_offset"} for f in scan_text(text, file, rules)]
    want.sort(key=lambda f: (f["file"].encode(), f["offset"], f["rule_id"]))
    assert got == want
    assert len(got) > 100


def applies(rule, file):
    from glyphsieve.functions import globs

    return globs.matches(file, list(rule.include)) and not globs.matches(file, list(rule.exclude), dots=True)


def test_batches_go_in_slices(monkeypatch):
    """What is worked on at once follows the slice, not the batch: by lines and columns here, by rows of fixes."""
    texts = [f"{i} {D}\n{D}" * (i % 9 + 1) for i in range(400)] + ["x" * 9000 + D, f"{D}"]
    batch = pa.RecordBatch.from_pydict({"file": [f"{i}.md" for i in range(len(texts))], "text": texts, "on": [[True]] * len(texts), "held": [False] * len(texts)})
    batch = batch.slice(3, len(texts) - 4)
    runs = {"scan": batchscan.scanner([EM], [True], extra=("context",)), "fix": fix._fixing([Rule("em", ("**",), chars=(D,), fix="-")], 1, False, True, {})}
    want = {k: pa.Table.from_batches(run([batch])) for k, run in runs.items()}
    most, places = [], batchscan.Places
    monkeypatch.setattr(batchscan, "Places", lambda part: most.append(sum(map(len, part.to_pylist()))) or places(part))
    monkeypatch.setattr(batchscan, "SLICE", 2000)
    got = {k: list(run([batch])) for k, run in runs.items()}
    for k in runs:
        assert pa.Table.from_batches(got[k]).equals(want[k])
    assert len(most) >= 10
    assert sorted(most)[-2] <= 2000 < max(most)  # the long text goes alone
    assert len(got["fix"]) == len(most)
    assert [b.num_rows for b in batchscan.slices(batch.slice(0, 0))] == []
    assert sum(b.num_rows for b in batchscan.slices(batch)) == batch.num_rows


def test_scopes_and_functions_in_spark(spark):
    rows = corpus()
    rules = [Rule(s, ("**",), pattern=f"\\s*{D}\\s*", scope=s, fix=clause_separator) for s in ("markdown", "html", "strings", "markup")]
    assert not any(map(is_native, rules))
    got = ordered(scan(spark.createDataFrame(rows, FILES), rules, internal=True)).collect()
    want = [f for file, text in rows if file and text for f in scan_text(text, file, rules)]
    assert sorted((r.file, r.offset, r.rule_id, r.replacement) for r in got) == sorted((f["file"], f["offset"], f["rule_id"], f["replacement"]) for f in want)
    texts = dict(rows)
    for r in got:
        assert texts[r.file].removeprefix("\ufeff")[r.cp_offset :].startswith(r.match)


def test_empty_tables_and_rules(spark):
    none = spark.createDataFrame([], FILES)
    assert scan(none, RULES).count() == 0
    assert scan(spark.createDataFrame(corpus(), FILES), []).columns == [c.split()[0] for c in FINDINGS.split(", ")]
    with pytest.raises(ValueError, match="two rules"):
        scan(none, [EM, EM])


def test_anti_join_gives_what_the_scan_leaves_out(spark):
    df = spark.createDataFrame([(f"f{i}.js", t) for i, (t, _) in enumerate(SILENT)] + corpus(), FILES)
    every = scan(df, [EM], marker="another")
    assert sorted(without_suppressed(every, suppressions(df)).collect()) == sorted(scan(df, [EM]).collect())
    assert every.count() > scan(df, [EM]).count()


def test_jsx_files_are_skipped(spark):
    df = spark.createDataFrame([("a.tsx", D), ("b.ts", f"'{D}'"), ("c.vue", f"<script lang='jsx'>'{D}'</script>"), ("d.tsx", "plain")], FILES)
    rules = [EM, Rule("s", ("**/*.{ts,tsx}",), chars=(D,), scope="strings"), Rule("m", ("**/*.vue",), chars=(D,), scope="markup")]
    assert {r.file for r in skipped(df, rules).collect()} == {"a.tsx", "c.vue"}
    assert {r.file for r in scan(df, rules, jsx=False).collect()} == {"b.ts"}
    assert {(r.file, r.rule_id) for r in scan(df, rules).collect()} == {("a.tsx", "em"), ("b.ts", "em"), ("b.ts", "s"), ("c.vue", "em"), ("c.vue", "m")}


def test_plan(spark):
    df = spark.createDataFrame([("docs/a.md", ""), ("docs/b.txt", ""), (".x/c.md", ""), ("node_modules/d.md", ""), ("e.md", "")], FILES)
    rules = [Rule("md", ("**/*.md",), chars=("x",), scope="markdown"), Rule("all", ("**",), chars=("x",), exclude=("docs/**",)), Rule("html", ("**/*.txt",), chars=("x",), scope="html"), Rule("no", ("nowhere",), chars=("x",))]
    assert {(r.file, r.rule_id, r.supported) for r in plan(df, rules).collect()} == {("docs/a.md", "md", True), ("e.md", "md", True), ("e.md", "all", True), ("docs/b.txt", "html", False)}
    assert {(r.file, r.rule_id) for r in plan(df, rules, ignore=["e.*"], paths=["./docs/a.md", "e.md", "docs"]).collect()} == {("docs/a.md", "md")}
    assert {r.rule_id: r.status for r in rule_counts(df, rules).collect()} == {"md": "ok", "all": "ok", "html": "unreadable scope", "no": "no files"}
    assert len(warnings(df, rules)) == 2


def test_apply_fixes():
    def f(at, match, new):
        return {"offset": at, "match": match, "replacement": new}

    assert fix.apply_fixes("abcdef", [f(1, "b", "X"), f(3, "de", "")]) == ("aXcf", 2, 0, 0)
    assert fix.apply_fixes("abcdef", [f(1, "bc", "X"), f(2, "c", "Y")]) == ("abYdef", 1, 1, 0)
    assert fix.apply_fixes("abc", [f(1, "x", "Y")]) == ("abc", 0, 0, 1)
    assert fix.apply_fixes("\ufeffab\r\n", [f(0, "a", "c")]) == ("\ufeffcb\r\n", 1, 0, 0)
    assert fix.apply_fixes(f"{R}ab", [f(2, "a", "c"), f(9, "q", "r")]) == (f"{R}cb", 1, 0, 1)
    assert fix.apply_fixes("ab", [f(0, "a", None)]) == ("ab", 0, 0, 0)


def test_native_fold_is_the_plain_one_and_linear(spark):
    rng, rows, want = random.Random(3), [], {}
    for i in range(120):
        n = rng.choice([0, 1, 5, 50, 300, 2000])
        text = "".join(rng.choice(f"ab{D}\u00e9{R}\n") for _ in range(n))
        places = [(rng.randrange(n + 3), rng.choice([1, 1, 2, 5, 40, 300])) for _ in range(rng.choice([0, 1, 3, 64, 65, 200]))]
        found = [(at, text[at : at + size] if rng.random() < 0.7 else "zz", rng.choice(["", "-", f"XY{R}"])) for at, size in places if text[at : at + size]]
        rows.append((i, text, found))
        out, before, counts = text, 2**62, [0, 0, 0]
        for at, match, new in sorted(found, key=lambda f: -f[0]):
            kind = 1 if at + len(match) > before else 2 * (text[at : at + len(match)] != match)
            counts[kind] += 1
            if not kind:
                out, before = out[:at] + new + out[at + len(match) :], at
        want[i] = dict(zip(("text", "fixed", "overlap", "stale"), (out, *counts), strict=True))
    df = spark.createDataFrame(rows, "i int, text string, found array<struct<at:bigint,match:string,replacement:string>>")
    folded = fix.folded(F.col("text"), F.col("found"))
    assert {r.i: r.f.asDict() for r in df.select("i", folded.alias("f")).collect()} == want
    many = 40_000
    long = spark.createDataFrame([(f"{R} {D} " * many, [(4 * k + 2, D, "-") for k in range(many)])], "text string, found array<struct<at:bigint,match:string,replacement:string>>")
    began = time.perf_counter()
    [r] = long.select(folded["text"].alias("text")).collect()
    assert r.text == f"{R} - " * many
    assert time.perf_counter() - began < 20  # 160,000 characters are cut once, not 40,000 times


def test_fixpoint(spark):
    df = spark.createDataFrame([("a.md", f"one {D} two {D} three"), ("b.md", "nothing"), ("held.md", D)], FILES)
    chain = [Rule("em", ("**",), chars=(D,), fix="\u2013"), Rule("en", ("**",), chars=("\u2013",), fix="-")]
    done = fix.fix_to_fixpoint(df, chain, hold=spark.createDataFrame([("held.md",)], "file string"))
    assert {r.file: r.text for r in done.files.collect()} == {"a.md": "one - two - three", "b.md": "nothing", "held.md": D}
    assert (done.fixed, done.converged, [r.file for r in done.changed.collect()]) == (4, True, ["a.md"])
    assert [r.file for r in done.findings.collect()] == ["held.md"]
    again = fix.fix_to_fixpoint(done.files, chain, hold=spark.createDataFrame([("held.md",)], "file string"))
    assert again.fixed == 0
    loop = [chain[0], Rule("back", ("**",), chars=("\u2013",), fix=D)]
    done = fix.fix_to_fixpoint(df, loop, max_passes=3)
    assert (done.fixed, done.converged, len(done.warnings)) == (9, False, 1)


def one_by_one(text, file, rules, most):
    fixed = overlap = 0
    for _ in range(most):
        new, n, over, _ = fix.apply_fixes(text, scan_text(text, file, rules))
        fixed, overlap = fixed + n, overlap + over
        if new == text:
            break
        text = new
    return text, fixed, overlap


@pytest.mark.parametrize(
    ("rules", "scans"),
    [
        ([Rule("em", ("**",), chars=(D,), fix="\u2013"), Rule("en", ("**",), chars=("\u2013",), fix=D)], 2),
        ([Rule("a", ("**",), chars=("a",), fix="b"), Rule("b", ("**",), chars=("b",), fix="c"), Rule("c", ("**",), chars=("c",), fix="a")], 3),
        ([Rule("wide", ("**",), pattern=f"{D}b", fix="x"), Rule("b", ("**",), chars=("b",), fix="c"), Rule("c", ("**",), chars=("c",), fix="b")], 2),
        ([Rule("more", ("**",), chars=("a",), fix="aa")], 11),
    ],
)
def test_passes_that_go_round_are_counted_and_not_run(monkeypatch, rules, scans):
    text, reads, read = f"\ufeffa{D}b{R} \u2013c {D}", [], fix.matches_of
    monkeypatch.setattr(fix, "matches_of", lambda *args, **options: reads.append(args) or read(*args, **options))
    for most in (1, 2, 3, 4, 5, 9, 10):
        reads.clear()
        steps, fixed, overlap, _, more = fix.passes_over(text, "a.md", rules, most)
        assert ((steps[-1], fixed, overlap), len(steps), more) == (one_by_one(text, "a.md", rules, most), most, True)
    assert len(reads) == scans


def test_contexts_by_either_way():
    for c in [chr(k) for k in range(0x3100)] + [BOM, R]:
        text = f"{c} a {c}{c}b\t\u2003{D} {c}\n{c}"
        at = text.index(D)
        assert context_of(text, at, 1, is_plain(text)) == context_of(text, at, 1)
    assert not is_plain("a\x1cb")
    assert is_plain(f"a \u00a0{D}")


def test_baseline_split_moves_rows_once(spark, monkeypatch):
    rng = random.Random(8)

    def pick(values, null=0.1):
        return None if rng.random() < null else rng.choice(values)

    found = [(pick(["em", "en"]), pick("abcde"), 3 * k, pick("pqr"), f"m{k}") for k in range(150)]
    entries = [(pick("abcdef"), pick(["em", "en"]), pick("pqx"), pick([0, 0, 1, 2]), k) for k in range(150)]
    seen, exact, counted, left = {}, set(), set(), list(entries)
    for f in found:  # by offset
        key = (f[1], f[0], f[3])
        n = seen[key] = seen.get(key, -1) + 1
        twin = next((e for e in left if (*e[:3], e[3]) == (*key, n)), None) if None not in key else None
        if twin:
            left.remove(twin)
            exact.add(f)
    for f in found:
        twin = next((e for e in left if e[:2] == (f[1], f[0])), None) if f not in exact and None not in f[:2] else None
        if twin:
            left.remove(twin)
            counted.add(f)
    made, keep = [], baseline.kept
    monkeypatch.setattr(baseline, "kept", lambda df: made.append(df) or keep(df))
    parts = baseline.split(spark.createDataFrame(found, "rule_id string, file string, offset bigint, context string, match string"), spark.createDataFrame(entries, baseline.ENTRIES))
    assert {tuple(r) for r in parts.baselined.collect()} == exact | counted
    assert {tuple(r) for r in parts.reported.collect()} == set(found) - exact - counted
    assert sorted(repr(tuple(r)) for r in parts.stale.collect()) == sorted(repr(e[:4]) for e in left)
    assert len(exact) > 5 < len(counted)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (*made, parts.reported, parts.baselined, parts.stale)]
    assert sum(p.count("Exchange hashpartitioning") for p in plans) == 1


def test_baseline(spark, tmp_path):
    files = spark.createDataFrame([("a.md", f"one {D} two\nthree {D} four"), ("b.md", f"{D} x {D}")], FILES)
    found = scan(files, [EM], internal=True)
    path = str(tmp_path / "deep" / "base.json")
    baseline.write(baseline.entries_for(found), path)
    known = baseline.read(spark, path)
    assert known.count() == 4
    parts = baseline.split(found, known)
    assert (parts.reported.count(), parts.baselined.count(), parts.stale.count()) == (0, 4, 0)
    new = spark.createDataFrame([("a.md", f"new {D} text before one {D} two and what follows\nthree   {D}\nfour"), ("b.md", "gone")], FILES)
    parts = baseline.split(scan(new, [EM], internal=True), known)
    assert (parts.reported.count(), parts.baselined.count(), parts.stale.count()) == (1, 2, 2)
    assert baseline.split(scan(new, [EM], internal=True), known, new.filter("file = 'a.md'").select("file")).stale.count() == 0
    assert baseline.read(spark, str(tmp_path / "no.json")) is None
    for bad in ("[]", "{", '{"version": 2, "entries": []}', '{"version": 1}', '{"version": 1, "entries": [{"file": "a"}]}', '{"version": 1, "entries": [{"file": "a", "ruleId": "b", "context": "c", "ordinal": -1}]}'):
        with pytest.raises(baseline.BaselineError):
            baseline.parsed(bad, "x")
    assert baseline.serialized([]) == '{\n  "version": 1,\n  "entries": []\n}\n'


def test_messages(spark):
    rows = [("# c\nSubject\n\nbody # kept\n# ------------------------ >8 ------------------------\ndiff",), ("Merge x",), ("Merged x",), ("\n#c\nfixup! y\r\nz",), (None,)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "text string").select(messages.masked(F.col("text")).alias("m")).select("m.*").collect()]
    assert got[0][0].split("\n") == ["   ", "Subject", "", "body # kept", " " * 54, "    "]
    assert not got[0][1]
    assert len(got[0][0]) == len(rows[0][0])
    assert got[1] == (" " * 7, True)
    assert got[2] == (" " * 8, True)  # the beginning decides
    assert got[3][1]
    assert got[3][0].count("\r\n") == 1


def test_reports(spark):
    import json

    files = spark.createDataFrame([("a.md", f"x {D}\r\ny \u200b"), ("b.md", D)], FILES)
    rules = [EM, Rule("zw", ("**",), chars=("\u200b",), message="Gone.", severity="warn", fix="")]
    found = scan(files, rules, excerpts=True)
    assert report.summary(found).first().asDict() == {"errors": 2, "warnings": 1, "fixable": 1, "files": 2}
    whole = json.loads(report.json_report(found, quiet=True))
    assert (whole["schemaVersion"], len(whole["findings"]), whole["summary"]["warnings"]) == (1, 2, 1)
    assert "replacement" not in whole["findings"][0]
    run = json.loads(report.sarif_report(found, version="1"))["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["em", "zw"]
    assert run["results"][1]["level"] == "warning"
    assert "endLine" not in run["results"][0]["locations"][0]["physicalLocation"]["region"]
    text = report.pretty_report(found)
    assert f"a.md:1:3\n  x {D}\n    ^\n  error  em  Banned character U+2014" in text
    assert "Gone. (U+200B)" in text
    assert "2 errors, 1 warning in 2 files (1 fixable with --fix)" in text
    assert "\x1b" in report.pretty_report(found, color=True)
    lit = F.lit
    cases = [((1, 0), {}, 1), ((0, 3), {"max_warnings": 2}, 1), ((0, 3), {"max_warnings": 3}, 0), ((0, 0), {"strict_stale": lit(1)}, 1), ((0, 0), {"converged": lit(False)}, 2), ((1, 0), {"converged": lit(False)}, 1), ((0, 0), {"skipped": lit(2)}, 2), ((0, 0), {}, 0)]
    for (e, w), options, want in cases:
        assert spark.range(1).select(report.exit_code(lit(e), lit(w), **options).alias("c")).first().c == want
