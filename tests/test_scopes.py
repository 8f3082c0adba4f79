"""Golden cases of the scopes: which dashes a rule sees. Texts are our own."""

import pytest

from glyphsieve.operators.scopes import JsxError, chunks_of
from glyphsieve.operators.scopes.literals import literals
from glyphsieve.operators.textscan import scan_text
from glyphsieve.plans.rules import Rule

D = "\u2014"


def seen(scope, file, text, pattern=D, **options):
    found = scan_text(text, file, [Rule("r", ("**",), pattern=pattern, scope=scope)], **options)
    for f in found:
        assert text[f["offset"] : f["offset"] + len(f["match"])] == f["match"]
    return found


def lines(scope, file, text, **options):
    return [f["line"] for f in seen(scope, file, text, **options)]


MARKDOWN = f"""---
title: matter {D} yes
---

# Heading {D} yes

Link [text {D} yes](http://x.y/{D}no "title {D} yes") and ![alt {D} yes](i.png).
Before `code {D} no` after {D} yes.

```js {D} no
{D} no
```

~~~~
{D} no
~~~
{D} no
~~~~

    {D} no

> quote {D} yes
lazy {D} yes

- item {D} yes

      {D} no
1. other {D} yes

<div title="{D} no">
{D} no
</div>

<http://a.b/{D}no> and {D} yes

[ref]: /u{D}no "title {D} yes"

Set {D} yes
===

a | b {D} yes
--|--
\\{D} yes *em {D} yes* &mdash;
"""


def test_markdown():
    want = [i for i, line in enumerate(MARKDOWN.split("\n"), 1) for _ in range(line.count(f"{D} yes"))]
    assert lines("markdown", "a.md", MARKDOWN) == want
    assert lines("markdown", "a.markdown", MARKDOWN) == want
    assert lines("markdown", "a.mdx", MARKDOWN) == []


def test_markdown_chunks():
    def texts(t):
        return [t[a:b] for a, b, _ in chunks_of("markdown", t, "x.md")]

    assert texts("one\ntwo\n\nthree") == ["one\ntwo", "three"]
    assert texts("> one\n> two") == ["one\n> two"]
    assert texts("a `b`\nc") == ["a ", "\nc"]
    assert texts("a&amp;b \\* c") == ["a", "b ", " c"]
    assert texts("**a** _b_ c*") == ["a", " ", "b", " c*"]
    assert texts("[x] y\n\n[x]: z") == ["x", " y"]
    assert texts("---\nkey: v\n...\ntext") == ["key: v\n", "text"]
    assert texts("---\nnot closed") == ["not closed"]
    assert texts("") == []


def test_a_match_is_cut_to_its_chunk():
    found = seen("markdown", "a.md", f"words {D}\n`code` more", f"\\s*{D}\\s*")
    assert [f["match"] for f in found] == [f" {D}"]
    assert [f["offset"] for f in seen("html", "a.html", "<p>a b c</p>", "[ac][\\s\\S]{3}")] == [3]
    assert [f["match"] for f in seen("html", "a.html", "<p>a B</p>", "\\s*B[\\s\\S]*")] == [" B"]


HTML = f"""<!DOCTYPE html><html><head>
<title>{D} yes</title><meta name="d" content="{D} yes"><div content="{D} no">
<style>p::after {{ content: "{D} no" }}</style>
<!-- {D} no --></head><body>
<p title="{D} yes" data-x="{D} no">text {D} yes
wrapped {D} yes <code>{D} no</code> after {D} yes</p>
<img alt='{D} yes'><img alt={D}yes>
<pre title="{D} yes">{D} no <b>{D} no</b></pre>
<textarea>{D} yes <i>{D} yes</i></textarea><template><p>{D} yes</p></template><noscript>{D} yes</noscript>
<script>// {D} no
let x = "{D} yes" / 2;</script>
<script type="application/json">{{"a": "{D} no"}}</script>
<kbd>{D} no</kbd>&amp; {D} yes
<p><kbd>{D} no<p>{D} yes
</body></html>
"""


def test_html():
    want = [i for i, line in enumerate(HTML.split("\n"), 1) for _ in range(line.count(f"{D} yes") + line.count(f"{D}yes"))]
    assert lines("html", "a.html", HTML) == want
    assert lines("html", "a.HTM", HTML) == want
    assert lines("html", "a.md", HTML) == []
    assert lines("html", "a.html", HTML.replace("\n", "\r\n")) == want


def test_html_offsets():
    text = "<p>AB</p>"
    for pattern, want in (("A", [3]), ("B", [4]), ("AB", [3]), (">", []), ("<", []), ("p", [])):
        assert [f["offset"] for f in seen("html", "a.html", text, pattern)] == want
    assert seen("html", "a.html", f"<body>hello</body><!-- c {D} -->tail") == []
    assert len(seen("html", "a.html", "<p>a &amp; b</p>", "&")) == 1
    assert len(seen("html", "a.html", f'<a href="{D}" title="{D}">', text_attributes=("href",))) == 1


VUE = f"""<!-- {D} no -->
<template>
  <p title="{D} yes">text {D} yes {{{{ say("{D} yes") }}}} {{{{ a {D} b }}}}</p>
  <x :title="f('{D} yes')" v-bind:alt="`{D} yes`" :other="'{D} no'" content="{D} no" />
  <!-- {D} no --><template #s><b>{D} yes</b></template>
</template>
<script setup lang="ts">
const a: string = "{D} yes"; // {D} no
</script>
<script>
export default {{ n: '{D} yes' }}
</script>
<style>.a {{ content: "{D} no" }}</style>
<docs>{D} no</docs>
"""


def test_components():
    want = [i for i, line in enumerate(VUE.split("\n"), 1) for _ in range(line.count(f"{D} yes"))]
    assert lines("markup", "a.vue", VUE) == want
    assert lines("markup", "a.html", VUE) == []
    with pytest.raises(JsxError):
        chunks_of("markup", '<script lang="tsx">"x"</script>', "a.vue", jsx=False)


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ('a / b / "x"', ['"x"']),
        ('if (x) /"no"/.test(y); "b"', ['"b"']),
        ('f(x) / "b" / 2', ['"b"']),
        ('y = a ? /no"/ : "s"', ['"s"']),
        ("`q ${ {b: 'z'} } w ${`in ${1}`}`", ["`q ${", "'z'", "} w ${", "`in ${", "}`", "}`"]),
        ('// "no"\n/* "no" */ "yes"', ['"yes"']),
        ('class A { m() {} } /no"/.test("s")', ['"s"']),
        ('x = {} / "s"', ['"s"']),
        ('{} /no"/; "s"', ['"s"']),
        ('return /[/"]/.test(a), "s"', ['"s"']),
        ('a.return / "s" / 1', ['"s"']),
        ('x! / "s"', ['"s"']),
        ('!/no"/.test("s")', ['"s"']),
        ("'it\\'s' + \"two\"", ["'it\\'s'", '"two"']),
        ("i++ / 's'", ["'s'"]),
        ("#!/usr/bin/env 'no'\n'yes'", ["'yes'"]),
        ("", []),
    ],
)
def test_literals(code, want):
    assert [code[a:b] for a, b in literals(code)] == want


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("const a = <p title='t' data-x=\"d\">it's text</p>; 'after'", ["'t'", '"d"', "'after'"]),
        ("return (<div>{a ? 'yes' : <b>don't</b>} isn't {`q ${x}`}</div>)", ["'yes'", "`q ${", "}`"]),
        ("x = <><br/>can't<hr /></>, 'z'", ["'z'"]),
        ("f(<A.B {...{k: 'v'}} on={() => { g('h') }} />, 's')", ["'v'", "'h'", "'s'"]),
        ("x = <A icon=<B c='d'/> e='f'>t's</A> / 2; 'g'", ["'d'", "'f'", "'g'"]),
        ("const f = <T,>(x: T) => 'a'; const g = <T extends U>(x: T) => \"b\"", ["'a'", '"b"']),
        ("if (a < b && c > d) 'x'", ["'x'"]),
        ("x = <List<Item> of='y'>{/* don't */}{'z'}</List>", ["'y'", "'z'"]),
        ("x = <p>{", []),
        ("x = <p a='never closed", ["'never closed"]),
        ("y = <p // it's a comment\n b='c'/>", ["'c'"]),
    ],
)
def test_elements(code, want):
    assert [code[a:b] for a, b in literals(code, jsx=True)] == want


def test_strings_scope():
    found = seen("strings", "a.ts", f'const label = "one {D} two";')
    assert [(f["line"], f["column"]) for f in found] == [(1, 20)]
    assert len(seen("strings", "a.mjs", f"`head {D} ${{v}} tail {D}`")) == 2
    assert seen("strings", "a.py", f'"{D}"') == []
    with pytest.raises(JsxError):
        chunks_of("strings", "x", "a.tsx", jsx=False)


def test_many_chunks_and_one_match():
    text = "para `code` more\n\n" * 500 + f"tail {D}"
    assert len(seen("markdown", "a.md", text)) == 1
