"""The command line over real folders and git repositories."""

import json
import os
import subprocess

import pytest

from glyphsieve import cli
from glyphsieve.functions.chars import CHARS
from glyphsieve.plans import config

D = CHARS["EM_DASH"]
RULES = [{"id": "em", "chars": [D], "include": ["**/*.md", "<commit-msg>"], "fix": "-"}, {"id": "bang", "pattern": "!", "include": ["**/*.md"], "severity": "warn"}]


@pytest.fixture
def run(spark, tmp_path):
    def go(*args, cwd=None):
        out, err = [], []
        code = cli.run(list(args), lambda: spark, out.append, err.append, str(cwd or tmp_path))
        return code, "\n".join(out), "\n".join(err)

    return go


@pytest.fixture
def tree(tmp_path):
    def write(files, **more):
        (tmp_path / config.FILENAMES[0]).write_text(json.dumps({"rules": RULES} | more))
        for name, text in files.items():
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_bytes(text.encode())
        return tmp_path

    return write


def test_exit_codes_and_formats(run, tree):
    tree({"a.md": "fine\n", "b c+d%.md": f"x {D}!\n", "node_modules/x.md": D})
    code, out, _ = run("--format", "json")
    assert code == 1
    assert [(f["file"], f["ruleId"]) for f in json.loads(out)["findings"]] == [("b c+d%.md", "em"), ("b c+d%.md", "bang")]
    assert run("a.md")[0] == 0
    assert run("--max-warnings", "x")[0] == 2
    assert json.loads(run("--format", "sarif", "--quiet")[1])["runs"][0]["results"][0]["ruleId"] == "em"
    assert run("--version")[:2] == (0, cli.VERSION)
    assert "file1" in run("--report-issue")[1] or "rule 1" in run("--report-issue")[1]


def test_fix(run, tree):
    root = tree({"a.md": f"one {D} two\r\n", "b.md": "ok!"})
    code, out, _ = run("--fix")
    assert code == 0
    assert "1 finding fixed" in out
    assert (root / "a.md").read_bytes() == b"one - two\r\n"
    assert run("--max-warnings", "0")[0] == 1


def test_baseline(run, tree):
    root = tree({"a.md": f"one {D} two\n"}, baseline=True)
    assert "no baseline" in run()[2]
    assert run("--baseline-write")[0] == 0
    assert run()[0] == 0
    assert run("--no-baseline")[0] == 1
    (root / "a.md").write_text(f"one {D} two\nand {D} more words\n")
    assert run()[0] == 1
    (root / "a.md").write_text("clean\n")
    assert run()[0] == 0
    assert run("--baseline-strict")[0] == 1
    (root / "glyphsieve-baseline.json").write_text("{")
    assert run()[0] == 2


@pytest.mark.parametrize("args", [("--staged", "--commit-msg", "x"), ("--staged", "a.md"), ("--baseline", "--no-baseline"), ("--baseline-write", "a.md"), ("--verbatim",), ("--report-issue", "--fix"), ("--commit-msg", "m", "--fix"), ("--nothing",), ("--format", "xml")])
def test_usage(run, args):
    assert run(*args)[0] == 2


def git(root, *args):
    subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@example.org", *args], cwd=root, check=True, capture_output=True)


def test_staged_and_messages(run, tree):
    root = tree({"a.md": f"{D}\n", "b.md": "ok\n", "sub/c.md": f"{D}\n"})
    git(root, "init", "-q")
    git(root, "add", "a.md", "b.md")
    (root / "b.md").write_text(f"{D}\n")
    code, out, _ = run("--staged", "--format", "json")
    assert (code, [f["file"] for f in json.loads(out)["findings"]]) == (1, ["a.md"])
    git(root, "add", "b.md")
    (root / "b.md").write_text(f"{D} more\n")
    code, _, err = run("--staged", "--fix")
    assert code == 1
    assert "b.md is staged in part" in err
    assert (root / "a.md").read_text() == "-\n"
    (root / "msg").write_text(f"Subject {D}\n# comment {D}\n")
    code, out, _ = run("--commit-msg", "msg")
    assert code == 1
    assert out.count("error  em") == 1
    (root / "msg").write_text(f"Merge {D}\n")
    assert run("--commit-msg", "msg")[0] == 0


def test_config(tmp_path):
    with pytest.raises(config.ConfigNotFoundError):
        config.load(str(tmp_path))
    (tmp_path / "package.json").write_text(json.dumps({"glyphsieve": {"rules": RULES, "markup": {"textAttributes": ["x"]}}}))
    (tmp_path / "deep").mkdir()
    loaded = config.load(str(tmp_path / "deep"))
    assert loaded.root == str(tmp_path)
    assert config.scan_options(loaded)["text_attributes"] == ("x",)
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path), "no.json")
    bad = {
        "rules": [1, {"id": "", "chars": ["a"], "pattern": "b"}, {"id": "x", "chars": [], "include": []}, {"id": "x", "pattern": "(", "include": "a"}, {"id": "y", "chars": [""], "include": ["*.md"], "scope": "html", "severity": "no", "fix": 1, "message": 2}],
        "ignore": [1],
        "textAttributes": [],
        "markup": {"textAttributes": []},
        "baseline": " ",
    }
    with pytest.raises(config.ConfigError) as caught:
        config.validate(bad)
    assert len(caught.value.problems) == 17
    for nothing in (None, {}, {"rules": []}):
        with pytest.raises(config.ConfigError):
            config.validate(nothing)


def test_stream(spark, tmp_path):
    from glyphsieve.operators import baseline
    from glyphsieve.operators.scan import scan
    from glyphsieve.plans.rules import Rule
    from glyphsieve.streaming import files as streaming

    em = [Rule("em", ("**",), chars=(D,))]
    one = spark.createDataFrame([("a.md", f"x {D} y"), ("b.md", "none")], "file string, text string")
    one.write.parquet(str(tmp_path / "in"))
    stream = streaming.stream(spark, str(tmp_path / "in"))
    q = streaming.scanned(stream, em).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("found").collect() == scan(one, em).collect()
    known = baseline.entries_for(scan(one, em, internal=True)).selectExpr("*", "1 AS pos")
    got = []
    q = streaming.against_baseline(stream, em, known, lambda df, n: got.append(df.count()), str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    assert sum(got) == 0


def test_folder(spark, tmp_path, monkeypatch):
    from glyphsieve.sources import files as sources

    for name in ("a.md", "sub/b.md", "node_modules/x/c.md", "sub/.git/d", "skip/e.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"\xff x" if name == "a.md" else b"y")
    (tmp_path / "loop").symlink_to("loop")
    (tmp_path / "gone").symlink_to("nowhere")
    entered = []
    scandir = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: entered.append(os.path.relpath(p, tmp_path)) or scandir(p))
    assert sources.walked(str(tmp_path)) == ["a.md", "gone", "loop", "skip/e.md", "sub/b.md"]
    assert "node_modules" not in entered
    assert "sub/.git" not in entered
    monkeypatch.undo()
    got = {r.file: r.text for r in sources.folder(spark, str(tmp_path), ignore=["node_modules/**", "**/.git/**", "skip/**"]).collect()}
    assert got == {"a.md": "\ufffd x", "sub/b.md": "y"}
    assert [r.file for r in sources.unreadable(spark, str(tmp_path)).collect()] == ["loop"]
    by_spark = sources.folder(spark, f"file://{tmp_path}/sub", "*.md")
    assert {r.file: r.text for r in by_spark.collect()} == {"b.md": "y"}
