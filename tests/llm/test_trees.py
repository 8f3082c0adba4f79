"""Mixing, chat trees, page extraction and toxicity, against slow versions."""

import itertools
import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest

from glyphsieve.llm import chat, html_extract, mixing, toxicity
from tests.llm.conftest import words

# mixing


def pour(budget, children):
    """Water filling in whole numbers: {name: (cap, weight)} -> {name: share}."""
    share, left = {}, dict(children)
    while left:
        weight = sum(w for _, w in left.values())
        full = [n for n, (c, w) in left.items() if c * weight <= w * budget]
        if not full:
            return share | {n: w * budget // weight for n, (_, w) in left.items()}
        for n in full:
            share[n] = left[n][0]
        budget -= sum(share[n] for n in full)
        left = {n: x for n, x in left.items() if n not in share}
    return share


def slow_mix(rows, tree, percent, epochs, seed):
    import hashlib
    import re

    def domain(s):
        return next((d for d, names in tree.domains.items() if s in names), "other")

    leaves = defaultdict(list)
    for k, t, lang, source in rows:
        s = source or ""
        leaves[domain(s), lang or "", s].append((k, len(re.findall(r"[^ \t\r\n\f]+", t or ""))))
    supply = {x: sum(n for _, n in v) for x, v in leaves.items()}
    total = sum(supply.values()) * percent // 100
    leaves = {x: v for x, v in leaves.items() if supply[x]}
    cap = {x: supply[x] * epochs for x in leaves}

    def weights(level):
        return (tree.domain_weights, tree.language_weights, tree.source_weights)[level]

    def spread(prefix, budget):
        level = len(prefix)
        if level == 3:
            return {prefix: budget}
        below = defaultdict(int)
        for x, c in cap.items():
            if x[:level] == prefix and all(weights(i).get(x[i], 1) for i in range(3)):
                below[x[level]] += c
        out = {}
        for name, share in pour(budget, {n: (c, weights(level).get(n, 1)) for n, c in below.items()}).items():
            out |= spread((*prefix, name), share)
        return out

    got = []
    for x, share in spread((), total).items():
        whole, rest = divmod(share, supply[x])
        got += [(k, e, n) for e in range(whole) for k, n in leaves[x]]
        order = defaultdict(list)
        for k, n in leaves[x]:
            order[hashlib.md5(f"{seed}|{whole}|{'' if k is None else k}".encode()).hexdigest()].append((k, n))
        room = rest
        for _, group in sorted(order.items()):
            room -= sum(n for _, n in group)
            if room < 0 or not rest:
                break
            got += [(k, whole, n) for k, n in group]
    return sorted(got, key=repr)


@pytest.mark.parametrize(("percent", "epochs"), [(50, 3), (5, 1), (190, 2), (1000, 3), (0, 1)])
def test_mixing(docs_of, rng, percent, epochs):
    rows = [(i, words(rng, rng.choice([1, 5, 30, 200])), rng.choice(["en", "de", "fr"]), f"src{min(rng.randrange(9), rng.randrange(30))}", 1) for i in range(300)]
    df = docs_of(rows)
    tree = mixing.Tree({"web": ["src0", "src1", "src2"], "books": ["src3", "src4"]}, {"web": 5, "books": 2}, {"de": 3, "fr": 0}, {"src0": 2, "src5": 9})
    got = sorted([(r.doc_id, r.epoch, r.tokens) for r in mixing.selection(df, tree, percent=percent, max_epochs=epochs).collect()], key=repr)
    assert got == slow_mix([(r.doc_id, r.text, r.lang, r.source) for r in df.collect()], tree, percent, epochs, mixing.SEED)
    whole = mixing.mixed(df, tree, percent=percent, max_epochs=epochs)
    assert whole.columns == [c for c in df.columns if c != "epoch"] + ["epoch"]
    assert sorted([(r.doc_id, r.epoch) for r in whole.collect()], key=repr) == [(k, e) for k, e, _ in got]


def test_shortage_goes_to_siblings_first(spark):
    rows = [("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("b", "en", "s3", 1000)]
    tree = mixing.Tree()
    got = {r.source: r.share for r in mixing.allocate(spark.createDataFrame(rows, "domain string, lang string, source string, supply long"), tree, budget=400, max_epochs=1).collect()}
    assert got == {"s1": 10, "s2": 190, "s3": 200}
    got = {r.source: r.share for r in mixing.allocate(spark.createDataFrame(rows, "domain string, lang string, source string, supply long"), tree, budget=2005, max_epochs=1).collect()}
    assert got == {"s1": 10, "s2": 995, "s3": 1000}


def test_nothing_to_mix(empty):
    assert mixing.selection(empty).count() == 0
    assert mixing.mixed(empty, budget=100).count() == 0


# chat


def slow_tree(conversations):
    """{(root, path): (start, end, ids, spans, first position, tokens)} by walking sorted paths."""
    import hashlib

    def h(turn):
        return hashlib.md5("\n".join(turn).encode()).digest()

    nodes = {}
    for k, turns in conversations.items():
        for i in range(len(turns)):
            nodes.setdefault(tuple(turns[: i + 1]), []).extend([k] if i == len(turns) - 1 else [])
    out, at = {}, defaultdict(int)
    for path in sorted(nodes, key=lambda p: [h(t) for t in p]):
        tokens = chat.encode([chat.written_turn(*path[-1])])[0]
        start = at[path[0]]
        at[path[0]] += len(tokens)
        spans = []
        for i in range(1, len(path)):
            spans = chat.joined(spans, *out[path[:i]][:2])
        position = sum(out[path[:i]][1] - out[path[:i]][0] for i in range(1, len(path)))
        out[path] = (start, start + len(tokens), sorted(nodes[path]), spans, position, tokens)
    return {(chat._root([h(p[0])]), v[0]): (*v[1:], len(p) - 1) for p, v in out.items()}


@pytest.mark.parametrize("roots", [1, 2, 9])
def test_prefix_tree(spark, rng, roots):
    conversations = {}
    for k in range(120):
        turns = [("system", f"root {rng.randrange(roots)}")]
        for i in range(rng.randrange(5)):
            turns.append(("user" if i % 2 == 0 else "assistant", words(rng, 3) if rng.random() < 0.2 else rng.choice(["yes", "no", "", "longer one"])))
        conversations[k] = turns
    rows = [(k, 10 * i, r, t, "x") for k, turns in conversations.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame([*rows, rows[0], (None, 0, "user", "lost", "x")], "conv_id long, turn long, role string, text string, path string")
    got = {}
    for r in chat.prefix_tree(df).collect():
        assert r.positions == list(range(r.positions[0], r.positions[0] + r.end - r.start))
        got[r.tree, r.start] = (r.end, sorted(r.conversations), [(s.start, s.end) for s in r.attends], r.positions[0], r.tokens, r.depth)
    assert got == slow_tree(conversations)


def test_ranks_and_the_tokenizers_library_agree(rng):
    texts = [words(rng, 60, "abcdéß ") for _ in range(20)] + ["a  b\n\n c \t d", "   ", "q" * 5000, "<|endoftext|> x", "日本 é 12 345!!", "it's I'll we've\r\n\r\n x", ""]
    got = chat.encode(texts)
    assert got == chat.encode(texts, "/opt/tokenizers/byte_bpe_50k.json")
    assert {x[-1] for x in got} == {50256}


def test_chat_edge_cases(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.prefix_tree(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (2, None, "", ""), (2, 5, "user", "a"), (2, 6, "user", "b" + " c" * 20000)]
    got = chat.prefix_tree(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.depth, sorted(r.conversations)) for r in got) == [(0, []), (1, []), (2, [1]), (2, [2])]


# pages


def test_min_cut_against_all_labellings(rng):
    for _ in range(200):
        n = rng.randint(1, 7)
        source, sink = ([rng.randint(0, 9) for _ in range(n)] for _ in range(2))
        edges = [(i, j, rng.randint(0, 6)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(on):
            return sum(t if x else s for s, t, x in zip(source, sink, on, strict=True)) + sum(c for i, j, c in edges if on[i] != on[j])

        best = min(cost(on) for on in itertools.product([False, True], repeat=n))
        got = html_extract.min_cut(source, sink, edges)
        assert cost(got) == best
        assert sum(got) == min(sum(on) for on in itertools.product([False, True], repeat=n) if cost(on) == best)


PAGE = "<html><head><title>A &amp; b</title><script>var t='</p>'</script><body><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><div class=ad>Buy now</div>{0}<footer>&copy; someone</footer>"


def test_siblings_with_much_between_are_joined():
    html = "<article><p>first one</p><ul>" + "".join(f"<li><div><div><div>item {i}</div></div></div></li>" for i in range(9)) + "</ul><p>second one</p></article>"
    blocks, _ = html_extract.blocks_of(html)
    a, b = (next(i for i, x in enumerate(blocks) if x.text == t) for t in ("first one", "second one"))
    assert b - a == 10
    weights = {(i, j): w for i, j, w in html_extract.edges_of(blocks, 0.6, 0.4)}
    assert weights[a, b] == int(0.4 / 3 * html_extract.SCALE)
    flat, _ = html_extract.blocks_of("<div>" + "".join(f"<p>block {i}</p>" for i in range(300)) + "</div>")
    assert len(html_extract.edges_of(flat, 0.6, 0.4)) < 10 * len(flat)


def test_near_blocks_are_linked_by_near_edges(rng):
    for _ in range(30):
        parts, depth = [], 0
        for i in range(40):
            move = rng.choice((-1, 0, 0, 1))
            if move > 0:
                parts.append("<div>")
                depth += 1
            elif move < 0 and depth:
                parts.append("</div>")
                depth -= 1
            parts.append(f"<p>block {i}</p>")
        blocks, _ = html_extract.blocks_of("".join(parts))

        def steps(i, j, blocks=blocks):
            a, b = blocks[i].path, blocks[j].path
            same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            return len(a) + len(b) - 2 * same

        edges = {(i, j): w for i, j, w in html_extract.edges_of(blocks, 0, 0.4)}
        assert all(w == int(0.4 / (1 + steps(i, j)) * html_extract.SCALE) and steps(i, j) <= html_extract.DISTANCE for (i, j), w in edges.items())
        for j in range(len(blocks)):
            for i in range(j):
                if blocks[i].path[:-1] == blocks[j].path[:-1] and not any(blocks[m].path[:-1] == blocks[j].path[:-1] for m in range(i + 1, j)):
                    assert (i, j) in edges


def test_extraction(spark, rng):
    body = "".join(f"<p>{words(rng, 40)}, {words(rng, 30)}. {words(rng, 20)}.</p>" for _ in range(4))
    tagged = [PAGE.format(f"<article><h1>{words(rng, 5)}</h1>{body}</article>") for _ in range(20)]
    weights = html_extract.train(*(np.concatenate(x) for x in zip(*map(html_extract.examples, tagged), strict=True)))
    text, title, blocks, kept = html_extract.extract(PAGE.format(f"<div><h2>Head line</h2>{body}</div>"), weights)
    assert title == "A & b"
    assert text.startswith("Head line\n")
    assert "Home" not in text
    assert "someone" not in text
    assert (blocks, kept) == (9, 5)
    rows = [(1, PAGE.format(body)), (2, None), (3, ""), (4, "<p " * 50000), (5, "no tags " * 20000), (None, "<b>x"), (1, PAGE.format(body)), (6, "<div>" * 3000 + "deep" + "<p>" * 3000)]
    df = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, html string, r string")
    got = {r.page_id: r for r in html_extract.extracted(df, html_extract.fit(df)).collect()}
    assert len(got) == 7
    assert got[2].text is None
    assert got[3].text == ""
    assert got[5].blocks == 1
    assert html_extract.extracted(df.limit(0), html_extract.fit(df.limit(0))).count() == 0


class SlowBlocks(HTMLParser):
    """Blocks of a well-formed page: (text, linked characters, path, tag)."""

    INLINE = ("a", "b", "i")

    def __init__(self, page):
        super().__init__()
        self.blocks, self.path, self.number, self.parts, self.linked, self.link = [], [], 0, "", 0, 0
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        text = " ".join(self.parts.split())
        if text:
            self.blocks.append((text, min(self.linked, len(text)), tuple(n for n, _ in self.path), self.path[-1][1] if self.path else ""))
        self.parts, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link += 1
        if tag not in self.INLINE:
            self.end()
            self.number += 1
            self.path.append((self.number, tag))

    def handle_endtag(self, tag):
        if tag == "a":
            self.link -= 1
        if tag not in self.INLINE:
            self.end()
            self.path.pop()

    def handle_data(self, data):
        self.parts += data
        if self.link:
            self.linked += len(data.strip())


def slow_extract(page, weights):
    """The labelling of least cost of all labellings, and of those with fewest content blocks."""
    blocks = SlowBlocks(page).blocks
    n = len(blocks)
    count = [len(re.findall(r"\w+", t)) for t, *_ in blocks]
    odds = []
    for i, (text, linked, path, tag) in enumerate(blocks):
        around = [np.log1p(count[j]) for j in (i - 1, i + 1) if 0 <= j < n]
        x = [1, np.log1p(count[i]), np.log1p(len(text)), min(1, len(re.findall(r"[.!?;:,](?=\s|$)", text)) / max(1, count[i]) * 5), linked / len(text), tag in ("p", "blockquote", "pre", "td"), tag in ("li", "ul", "ol", "option", "button", "label", "th"), tag in ("h1", "h2", "h3", "h4", "h5", "h6"), sum(around) / 2, any(c in text for c in "©·|"), i / max(1, n - 1), len(path) / 10]
        odds.append(float(np.clip(np.dot(x, weights), -20, 20)))
    content = [int(np.logaddexp(0, -z) * html_extract.SCALE) for z in odds]
    other = [int(np.logaddexp(0, z) * html_extract.SCALE) for z in odds]

    def steps(i, j):
        a, b = blocks[i][2], blocks[j][2]
        same = sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(a, b, strict=False)))
        return len(a) + len(b) - 2 * same

    edges = {}
    for j in range(n):
        for i in range(max(0, j - html_extract.AHEAD + 1), j):
            near = html_extract.NEAR / (1 + steps(i, j)) if steps(i, j) <= html_extract.DISTANCE else 0
            edges[i, j] = (html_extract.SMOOTH if j == i + 1 else 0) + near
        for up, down in itertools.product(range(html_extract.DISTANCE + 1), repeat=2):
            own = blocks[j][2]
            if up + down <= html_extract.DISTANCE and up <= len(own):
                before = [i for i in range(j) if down <= len(blocks[i][2]) and blocks[i][2][: len(blocks[i][2]) - down] == own[: len(own) - up]]
                if before and j - before[-1] >= html_extract.AHEAD:
                    edges[before[-1], j] = html_extract.NEAR / (1 + steps(before[-1], j))
    edges = {e: int(w * html_extract.SCALE) for e, w in edges.items()}

    def cost(on):
        return sum(content[i] if x else other[i] for i, x in enumerate(on)) + sum(w for (i, j), w in edges.items() if on[i] != on[j])

    best = min(itertools.product([False, True], repeat=n), key=lambda on: (cost(on), sum(on)))
    return "\n".join(t for (t, *_), x in zip(blocks, best, strict=True) if x), n, sum(best)


def random_page(rng):
    def inside(depth):
        out = ""
        for _ in range(rng.randint(1, 3)):
            if depth and rng.random() < 0.5:
                tag = rng.choice(["div", "section", "ul", "table"])
                out += f"<{tag}>{inside(depth - 1)}</{tag}>"
            else:
                tag, text = rng.choice(["p", "li", "h2", "div", "td"]), words(rng, rng.choice([1, 4, 30]))
                out += f"<{tag}>{text}{rng.choice(['', '.', ', ' + words(rng, 9) + '.', ' | x'])}{rng.choice(['', '<a href=x>' + words(rng, 3) + '</a>'])}</{tag}>"
        return out

    return f"<body>{inside(3)}</body>"


def test_extraction_against_all_labellings(spark, rng):
    pages = []
    while len(pages) < 40:
        page = random_page(rng)
        if 1 <= len(SlowBlocks(page).blocks) <= 11:
            pages.append(page)
    weights = html_extract.PRIOR
    got = {r.page_id: (r.text, r.blocks, r.kept) for r in html_extract.extracted(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"), weights).collect()}
    assert got == {i: slow_extract(p, weights) for i, p in enumerate(pages)}
    assert len({kept / n for _, n, kept in got.values()}) > 5


def test_a_repeated_page_counts_once(spark, rng):
    pages = [PAGE.format(f"<article>{''.join(f'<p>{words(rng, 30)}.</p>' for _ in range(3))}</article>") for _ in range(60)]
    once = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    often = once.unionByName(spark.range(20_000).selectExpr("id AS page_id", "'<nav>the same page <p>x</nav><article>y</article>' AS html"))
    x, y = html_extract.sample(often, "html", 61, 10_000, 5)
    assert len(y) == sum(len(html_extract.examples(p)[1]) for p in pages) + len(html_extract.examples("<nav>the same page <p>x</nav><article>y</article>")[1])
    again = html_extract.sample(often.repartition(3), "html", 61, 10_000, 5)
    assert (x == again[0]).all()
    assert (y == again[1]).all()
    assert len(html_extract.sample(often, "html", 61, 7, 5)[1]) == 7
    assert not len(html_extract.sample(once.limit(0), "html", 61, 7, 5)[1])


# toxicity


def slow_kernel(a, b):
    def features(word):
        f = defaultdict(float)
        for i, j, k in itertools.combinations(range(len(word)), 3):
            f[word[i], word[j], word[k]] += toxicity.DECAY ** (k - i + 1)
        return f

    x, y = features(a), features(b)
    return sum(v * y[u] for u, v in x.items())


def test_kernel(rng):
    for _ in range(30):
        a, b = (toxicity.as_letters("".join(rng.choice("abcd") for _ in range(rng.randint(3, 9)))) for _ in range(2))
        phi = toxicity.Nystrom([a, b]).phi
        assert np.isclose(phi[:, 0] @ phi[:, 1], slow_kernel(a, b) / np.sqrt(slow_kernel(a, a) * slow_kernel(b, b)), atol=1e-5)
        assert np.isclose(toxicity.norms(a[None])[0] ** 2, slow_kernel(a, a))


def test_nystrom_is_exact_for_landmarks(rng):
    marks = [toxicity.as_letters(w) for w in ("banana", "bandana", "cabane", "orange", "range", "zuvowex")]
    x = toxicity.Nystrom(marks).features(marks)[:, :-1]
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            assert np.isclose(x[i] @ x[j], slow_kernel(a, b) / np.sqrt(slow_kernel(a, a) * slow_kernel(b, b)), atol=1e-3)


def test_machine_finds_the_least_cost():
    r = np.random.default_rng(2)
    x = np.c_[r.normal(size=(60, 3)), np.ones(60)]
    y, cost = np.where(x[:, 0] + 0.3 * r.normal(size=60) > 0.2, 1.0, -1.0), r.random(60)

    def loss(w):
        return (cost * np.maximum(0, 1 - y * (x @ w)) ** 2).sum() + (w[:-1] ** 2).sum()

    w = toxicity.machine(x, y, cost, 1.0)
    assert all(loss(w) <= loss(w + d) + 1e-9 for d in r.normal(size=(300, 4)) * 0.01)


def labelled(rng, n=160):
    bad, good = [], []
    for i in range(n):
        text = words(rng, 60).split()
        if i % 2:
            for w in rng.sample(["zuvowex", "quortny"], 1 + (i % 4 == 1)):
                text[rng.randrange(60)] = w
        (bad if i % 2 else good).append(". ".join(" ".join(text[j : j + 12]) for j in range(0, 60, 12)))
    return bad, good


def test_gapped_and_inserted_letters(rng):
    bad, good = labelled(rng)
    model = toxicity.train(bad, good)
    tests = ["you z u v o w e x!", "such a zuvo-wex", "ZUVOOWEX", "quoxrtny", "a q.u.o.r.t.n.y b", "qu0rtny"]
    got = toxicity._result(pa.array([*tests, *labelled(rng)[1], *labelled(rng)[0]]), model).to_pylist()
    assert [g["toxic"] for g in got[: len(tests)]] == [True] * len(tests)
    clean, held = got[len(tests) : len(tests) + 80], got[len(tests) + 80 :]
    assert sum(g["toxic"] for g in clean) <= 1
    assert all(g["toxic"] for g in held)
    text = tests[0]
    assert text[got[0]["start"] : got[0]["end"]] == "z u v o w e x"


def test_scores_against_single_words(rng):
    bad, good = labelled(rng)
    model = toxicity.train(bad, good)

    def slow(word):
        w = [ord(c) - 97 for c in word]
        total = sum(toxicity.DECAY ** (k - i + 1) * model["table"][(w[i] * toxicity.LETTERS + w[j]) * toxicity.LETTERS + w[k]] for i, j, k in itertools.combinations(range(len(w)), 3))
        return float(total) / np.sqrt(slow_kernel(w, w)) + model["bias"]

    texts = bad[:30] + good[:30] + ["zuvowex", "x zuvo-wex.", "", "zu"]
    for text, got in zip(texts, toxicity._result(pa.array(texts), model).to_pylist(), strict=True):
        units = [(m[0].replace("-", ""), *m.span()) for m in re.finditer(r"[a-z]+(?:-[a-z]+)*", text) if len(m[0]) > 2]
        best = max(units, key=lambda u: (slow(u[0]), -u[1]), default=None)
        value = slow(best[0]) if best else -1.0
        assert got["toxic"] == (value > 0)
        assert np.isclose(got["score"], max(0.0, value), atol=1e-4)
        assert (got["start"], got["end"]) == ((best[1], best[2]) if value > 0 else (None, None))


def test_toxicity_of_held_out_documents():
    import pyarrow.parquet as pq

    docs = {r["doc_id"]: r["text"] for r in pq.read_table("/root/testdata/sf0.1/documents.parquet").to_pylist() if r["text"]}
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist() if r["toxic"] is not None and r["doc_id"] in docs}
    train = [k for k in labels if k % 2 and len(docs[k]) < 20_000]
    model = toxicity.train([docs[k] for k in train if labels[k]][:800], [docs[k] for k in train if not labels[k]][:800])
    known = {docs[k] for k in train}
    held = [k for k in labels if k % 2 == 0 and docs[k] not in known]
    found = dict(zip(held, (g["toxic"] for g in toxicity._result(pa.array([docs[k] for k in held]), model).to_pylist()), strict=True))
    toxic = [k for k in held if labels[k]]
    caught, wrong = sum(found[k] for k in toxic), sum(found[k] for k in held if not labels[k])
    assert len(toxic) > 100
    assert caught / len(toxic) > 0.75
    assert caught / (caught + wrong) > 0.75


def test_repeated_rows_and_many_texts_of_a_key_decide_nothing(spark, rng):
    bad, good = labelled(rng)
    df = spark.createDataFrame(list(enumerate(bad + good)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < len(bad))) for i in range(len(bad + good))], "doc_id long, toxic int")
    copies = spark.range(20_000).selectExpr(f"{len(bad)} AS doc_id", "'one clean text' AS text").unionByName(spark.range(5000).selectExpr(f"{len(bad) + 1} AS doc_id", "concat('clean text ', id) AS text"))
    model = toxicity.fit(df.unionByName(copies), labels.union(labels), sample_docs=60)
    rows = [(r.doc_id, r.toxic) for r in toxicity.judged(df, model).collect()]
    assert sum(t for k, t in rows if k < len(bad)) >= 0.95 * len(bad)
    assert sum(t for k, t in rows if k >= len(bad)) <= 0.05 * len(good)


def test_toxicity_edge_cases(spark, docs_of, empty, rng):
    bad, good = labelled(rng)
    df = docs_of([(i, t) for i, t in enumerate(bad + good)] + [(800, "nice " * 40000 + "zuvowex"), (801, "q" * 100000)])
    labels = spark.createDataFrame([(i, int(i < len(bad)), "x") for i in range(len(bad + good))] + [(None, 1, "x"), (3, None, "x"), (77777, 1, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit(df, labels)
    rows = {r.doc_id: r for r in toxicity.judged(df, model).collect()}
    assert rows[800].toxic
    assert rows[800].end == 5 * 40000 + 7
    assert not rows[801].toxic
    assert (rows[9001].toxic, rows[9001].score, rows[9001].start) == (False, 0.0, None)
    assert toxicity.fit(df, labels.limit(0)) is None
    assert toxicity.fit(empty, labels) is None
    assert toxicity.judged(df, None).filter("toxic").count() == 0
