import pytest

from glyphsieve.functions import chars, globs, patterns
from glyphsieve.functions.sentences import FixContext, clause_separator, is_fix_name, sentence_at, sentence_starts
from glyphsieve.functions.text import context_of, looks_binary, strip_bom
from glyphsieve.plans.rules import Rule, RuleError, UnsupportedScopeError, compile_rule, file_rules, invisibles, no_ai_punctuation, scope_supports, virtual_rules

D = "\u2014"


def test_descriptions():
    assert chars.describe(D) == "U+2014"
    assert chars.describe("a\U0001f680") == "U+0061 U+1F680"
    assert chars.is_invisible("\u200b\u00a0")
    assert not chars.is_invisible("")
    assert not chars.is_invisible("a\u200b")


@pytest.mark.parametrize(
    ("pattern", "path", "want"),
    [
        ("**/*.md", "a.md", True),
        ("**/*.md", "x/y/a.md", True),
        ("**/*.md", ".x/a.md", False),
        (".github/**/*.yml", ".github/a/b.yml", True),
        ("src/*.{ts,js}", "src/a.js", True),
        ("src/*.{ts,js}", "src/b/a.js", False),
        ("docs/**", "docs/a/b", True),
        ("docs", "docs/a", False),
        ("[!ab].md", "c.md", True),
        ("[!ab].md", "a.md", False),
        ("*", ".env", False),
        ("./a/?.md", "a/b.md", True),
        ("{a,b/{c,d}}/*", "b/d/x", True),
        ("f{1..3}.md", "f2.md", True),
        ("a+b.md", "a+b.md", True),
        ("a+b.md", "aab.md", False),
    ],
)
def test_globs(pattern, path, want):
    assert globs.matches(path, [pattern]) is want


def test_glob_extensions():
    assert globs.extensions("**/*.{ts, TSX}") == [".ts", ".tsx"]
    assert globs.extensions("**/*.Md") == [".md"]
    assert globs.extensions("docs/**") is None
    assert globs.extensions("*.{m*,x}") is None


def test_anonymous_globs():
    hide = globs.anonymizer()
    once = hide("src/**/secret-{a,b}.test.ts")
    assert once == "dir1/**/file2{file3,file4}.test.ts"
    assert hide("<commit-msg>") == "<commit-msg>"
    assert hide(".config/src/x.md") == ".dir5/dir1/file6.md"
    assert globs.anonymizer()(globs.anonymizer()("a/b.md")) == "dir1/file2.md"


@pytest.mark.parametrize("bad", ["(", "[a", "a{", "\\q", "*a", "a**", "a++", "(?i)a", "[b-a]", "\\u{110000}", "a]", "\\"])
def test_bad_patterns(bad):
    with pytest.raises(patterns.PatternError):
        patterns.for_java(bad)


@pytest.mark.parametrize(
    ("pattern", "text", "want"),
    [
        ("\\s", "\u0085\u00a0\ufeff\u001c", ["\u00a0", "\ufeff"]),
        ("\\bfoo\\b", "foo \u00e9foo fooo", ["foo", "foo"]),
        (".", "a\u0085\n\u2028", ["a", "\u0085"]),
        ("[^\\S\\n]+", "a \t\n b", [" \t", " "]),
        ("a$", "a\na", ["a"]),
        ("\\u{1F680}|\\uD83D\\uDE80", "\U0001f680", ["\U0001f680"]),
        ("(?<x>a)\\k<x>", "aa", ["aa"]),
        ("\\d+\\w", "\u0663a 12\u0663 3b", ["12", "3b"]),
        ("[a\\-z]", "-bz", ["-", "z"]),
        ("\\p{Script=Greek}+", "ab\u03b1\u03b2", ["\u03b1\u03b2"]),
    ],
)
def test_translated_patterns(spark, pattern, text, want):
    from pyspark.sql import functions as F

    assert [m[0] for m in patterns.for_python(pattern).finditer(text)] == want
    row = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(patterns.for_java(pattern)), F.lit(0)).alias("m")).first()
    assert row["m"] == want


def test_rules():
    assert Rule("a", ("**",), chars=("a", "ab", "\u2014")).source == "ab|a|\u2014"
    assert Rule("a", ("**",), chars=(".",)).python.fullmatch("x") is None
    for bad in (Rule("", ("**",), chars=("x",)), Rule("a", ("**",)), Rule("a", ("**",), chars=("x",), pattern="y"), Rule("a", ("**",), chars=()), Rule("a", ("**",), chars=("",)), Rule("a", ("**",), pattern="(")):
        with pytest.raises(RuleError):
            compile_rule(bad)
    with pytest.raises(UnsupportedScopeError):
        compile_rule(Rule("a", ("**",), chars=("x",), scope="nothing"))
    rules = [Rule("a", ("<commit-msg>",), chars=("x",)), Rule("b", ("<commit-msg>", "**/*.md"), chars=("x",))]
    assert [(r.id, r.include) for r in file_rules(rules)] == [("b", ("**/*.md",))]
    assert [r.id for r in virtual_rules(rules, "commit-msg")] == ["a", "b"]
    assert scope_supports("html", "A.HTM")
    assert not scope_supports("markdown", "a.mdx")


def test_presets():
    rules = [*no_ai_punctuation(include=["**"], id_prefix="p"), *invisibles(include=["**"], exclude=["x"], scope="markdown")]
    assert [r.id for r in rules] == ["p/no-fancy-dashes", "p/no-smart-quotes", "p/no-ellipsis-character", "p/no-exotic-spaces", "no-zero-width", "no-bidi-controls"]
    assert len(rules[-1].chars) == 11
    assert rules[-1].exclude == ("x",)
    assert rules[-1].scope == "markdown"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("One thing. Two things. Three.", ["One thing.", "Two things.", "Three."]),
        ("First line\ngoes on. Then", ["First line\ngoes on.", "Then"]),
        ("Ends here.\nnot a new one", ["Ends here.\nnot a new one"]),
        ("Ends here.\r\na new one", ["Ends here.", "a new one"]),
        ("# Head\ntext", ["# Head", "text"]),
        ("a\n\nb", ["a", "b"]),
        ("a\n- b\n2. c\n| d\n<p>e", ["a", "- b", "2.", "c", "| d", "<p>e"]),
        ('He said "no." And left', ['He said "no."', "And left"]),
        ("v1.2 is out; see", ["v1.2 is out;", "see"]),
    ],
)
def test_sentences(text, want):
    starts = sentence_starts(text)
    got = [sentence_at(text, starts, s)[0] for s in starts]
    assert [g for g in got if g] == want
    for s in starts:
        body, at = sentence_at(text, starts, s)
        assert text[at : at + len(body)] == body


def fixed(container, match=f" {D} ", nth=0):
    at = -1
    for _ in range(nth + 1):
        at = container.index(match, at + 1)
    return container[:at] + clause_separator(FixContext(container, match, at, "raw")) + container[at + len(match) :]


@pytest.mark.parametrize(
    ("container", "want"),
    [
        (f"prose {D} here", "prose: here"),
        (f"made of {D} and what", "made of, and what"),
        (f"note: it {D} there", "note: it, there"),
        (f"a {D} b {D} c {D} d", f"a, b {D} c {D} d"),
        (f"see `x: y` {D} there", "see `x: y`: there"),
        (f"at http://a.b {D} there", "at http://a.b: there"),
        (f"x {D} y. Z {D} w", f"x, y. Z {D} w"),
        (f"an android {D} android", "an android: android"),
    ],
)
def test_clause_separator(container, want):
    assert fixed(container) == want


def test_clause_separator_brackets_and_wraps():
    text = f"x {D} y {D} z"
    assert fixed(text) == f"x (y {D} z"
    assert fixed(text, nth=1) == f"x {D} y) z"
    assert fixed(f"one {D}\ntwo", f" {D}\n") == "one:\ntwo"
    assert fixed(f"one\r\n{D} two", f"\r\n{D} ") == "one:\r\ntwo"
    assert fixed(f"{D} a {D} b", f"{D} ") == f"(a {D} b"
    assert fixed(f"end {D}", f" {D}") == "end:"
    assert is_fix_name("clauseSeparator")
    assert not is_fix_name("other")


def test_contexts():
    one = f"some words before it {D} and more words after it"
    other = one.replace(" words ", "\n   words\t")
    assert context_of(one, one.index(D), 1) == context_of(other, other.index(D), 1)
    assert len(context_of(one, 0, 1)) == 12
    assert context_of(one, 3, 1) != context_of(one[:21] + "X" + one[21:], 3, 1)
    assert looks_binary("a\0")
    assert not looks_binary("a" * 8192 + "\0")
    assert strip_bom("\ufeff\ufeffa") == ("\ufeffa", True)


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("src/!(a|b).md", ["src/c.md", "src/ab.md", "src/aa.md"], ["src/a.md", "src/b.md", "src/c.txt", "src/.c.md", "x/c.md"]),
        ("!(node_modules)/*.js", ["src/x.js", "node_modules2/x.js"], ["node_modules/x.js", ".x/y.js"]),
        ("**/!(*.test).ts", ["a/b.ts", "c.ts"], ["a/b.test.ts"]),
        ("x!(1)", ["x", "x2", "x11"], ["x1", "y"]),
    ],
)
def test_negated_groups(spark, pattern, yes, no):
    from pyspark.sql import functions as F

    for path in yes + no:
        assert globs.matches(path, [pattern]) == (path in yes)
    df = spark.createDataFrame([(p,) for p in yes + no], "p string")
    assert {r.p for r in df.filter(F.col("p").rlike(globs.to_regex(pattern))).collect()} == set(yes)


def test_escaped():
    assert chars.escaped("a\u200b\U0001f680~\n") == "a\\u200b\\ud83d\\ude80~\\u000a"
