"""Operators that compare documents with each other, against slow versions."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from glyphsieve.llm import graph, ngram_join, queries, substring_dedup
from tests.llm.conftest import words


def grams(text, n):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def slow_partners(rows, n, threshold):
    """{key: (class, copies, links)} from all pairs of sets."""
    sets = defaultdict(set)
    for k, t in rows:
        if k is not None and grams(t, n):
            sets[grams(t, n)].add(k)
    label, links = {}, Counter()

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    def join(x, y):
        a, b = find(x), find(y)
        label[max(a, b)] = min(a, b)

    kinds = list(sets)
    for i, a in enumerate(kinds):
        for k in sets[a]:
            join(k, min(sets[a]))
        for b in kinds[:i]:
            if len(a & b) >= threshold * len(a | b) - 1e-12:
                links[a] += 1
                links[b] += 1
                join(min(sets[a]), min(sets[b]))
    out = {}
    for k in {k for v in sets.values() for k in v}:
        own = [a for a in kinds if k in sets[a]]
        copies, many = sum(len(sets[a]) - 1 for a in own), sum(links[a] for a in own)
        if copies + many:
            out[k] = (find(k), copies, many)
    return out


def partners(found):
    return {r.doc_id: (r.class_id, r.copies, r.links) for r in found.collect()}


@pytest.fixture
def similar_docs(docs_of, rng):
    rows, base = [], [words(rng, 40) for _ in range(8)]
    for i in range(150):
        text = base[i % 8].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
            text[rng.randrange(len(text))] = "new" + str(rng.randrange(50))
        rows.append((1000 - i, " ".join(text)))
    rows += [(2000 + i, words(rng, 60)) for i in range(40)] + [(3000, "one"), (3001, "One!"), (3002, "two words"), (3003, "e " * 30000), (1000, "another text with a used key")]
    return docs_of(rows)


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.85])
def test_similar_sets(similar_docs, threshold, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 7)
    monkeypatch.setattr(ngram_join, "CHUNK", 3000)
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", 1500)
    got = partners(ngram_join.similar_sets(similar_docs, threshold=threshold))
    assert got == slow_partners([(r.doc_id, r.text) for r in similar_docs.collect()], ngram_join.N, threshold)
    assert len(got) > 20


def test_similar_sets_joined_by_a_shuffle(similar_docs):
    got = partners(ngram_join.similar_sets(similar_docs, broadcast_bytes=0))
    assert got == slow_partners([(r.doc_id, r.text) for r in similar_docs.collect()], ngram_join.N, ngram_join.THRESHOLD)


def test_layout_and_keys_of_two_texts_change_nothing(spark, rng):
    """Two snapshots of a table have the same keys in the same places."""
    first = [(i, words(rng, 30)) for i in range(100)]
    second = [(i, first[(i * 37 + 11) % 100][1] if i % 2 else words(rng, 30)) for i in range(100)]
    rows = first + second
    want = slow_partners(rows, ngram_join.N, ngram_join.THRESHOLD)
    for parts in (1, 2, 7):
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
        assert partners(ngram_join.similar_sets(df)) == want
    assert sum(c for _, c, _ in want.values()) == 100


def test_a_popular_text_and_a_popular_passage(spark, rng):
    popular, passage = words(rng, 50), words(rng, 40)
    rows = [(i, popular if i % 3 == 0 else f"{words(rng, 8)} {passage} {words(rng, i % 40)}") for i in range(300)]
    got = partners(ngram_join.similar_sets(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == slow_partners(rows, ngram_join.N, ngram_join.THRESHOLD)
    assert got[0] == (0, 99, 0)


def test_a_chain_of_unlike_sets_does_not_meet(spark, rng, tmp_path, monkeypatch):
    """Each text has half of the next one: all are linked by rare grams, none is similar to another."""
    piece, popular = [words(rng, 20) for _ in range(121)], words(rng, 60).split()
    rows = [(i, f"{piece[i]} {piece[i + 1]}") for i in range(120)]
    rows += [(200 + i, " ".join([*popular[:i], f"new{i}", *popular[i + 1 :]])) for i in range(40)]
    plain = ngram_join._meet

    def watched(threshold, orders):
        meet = plain(threshold, orders)

        def see(table):
            (tmp_path / str(table["rid"][0])).write_text(str(len(table)))
            return meet(table)

        return see

    monkeypatch.setattr(ngram_join, "_meet", watched)
    got = partners(ngram_join.similar_sets(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == slow_partners(rows, ngram_join.N, ngram_join.THRESHOLD)
    assert [int(f.read_text()) for f in tmp_path.iterdir()] == [40]


@pytest.mark.parametrize("few", [1, 3, 32])
def test_no_similar_sets_are_parted(few, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "TESTS", 2000)
    rng = np.random.default_rng(few)
    base, sets = [rng.integers(0, 1 << 48, n).astype(np.uint64) for n in (3, 40, 300, 5000)], []
    for i in range(160):
        own = base[i % 4].copy()
        new = rng.permutation(len(own))[: rng.integers(0, 1 + len(own) // 2)]
        own[new] = rng.integers(0, 1 << 48, len(new))
        sets.append(np.unique(own[: len(own) * rng.integers(6, 11) // 10]))
    n = np.array([len(s) for s in sets])
    row, gram = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
    label = ngram_join.groups(row, gram, n, ngram_join.signatures(row, gram, n), 0.6)
    similar = [(i, j) for i in range(160) for j in range(i) if (s := len(np.intersect1d(sets[i], sets[j]))) >= 0.6 * (n[i] + n[j] - s) - 1e-9]
    assert len(similar) > 300
    assert all(label[i] == label[j] for i, j in similar)
    for split in (0, 1, 70):
        i, j, _ = ngram_join.similar(sets, 0.6, split=split)
        assert set(zip(j.tolist(), i.tolist(), strict=True)) == {(a, b) for a, b in similar if not split or b < split <= a}


def test_one_of_each_group_stays(similar_docs):
    kept = ngram_join.deduplicated(similar_docs)
    assert kept.columns == similar_docs.columns
    rows = similar_docs.collect()
    found = slow_partners([(r.doc_id, r.text) for r in rows], ngram_join.N, ngram_join.THRESHOLD)
    want = Counter(r.doc_id for r in rows if r.doc_id not in found or found[r.doc_id][0] == r.doc_id)
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_nothing_to_compare(empty):
    assert ngram_join.similar_sets(empty).count() == 0
    assert ngram_join.deduplicated(empty).columns == empty.columns
    assert substring_dedup.repeated_spans(empty).count() == 0


def test_components_spread_over_tasks(spark, rng):
    edges = [(0, rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1, i, i + 1) for i in range(40)]
    df = spark.createDataFrame(edges, "k int, a long, b long")
    small = {tuple(r) for r in graph.components(df).collect()}
    assert small == {tuple(r) for r in graph.components(df, local_edges=0).collect()}
    assert {c for k, _, c in small if k == 1} == {0}


def passages(rng):
    shared = [words(rng, 55, "abcdé") for _ in range(5)]
    rows = [(i, words(rng, rng.randint(0, 80)) + " " + shared[i % 5] + ". " + words(rng, 30)) for i in range(40)]
    rows += [(100 + i, words(rng, 90)) for i in range(20)] + [(200, shared[0] + " " + shared[0].upper()), (201, "x " * 5000)]
    return rows, shared


def spans_of_all_windows(rows, n):
    """{(key, start, end, windows, copies, first)} from every window of n words of every text, compared word by word."""
    places = defaultdict(list)
    for key, text in sorted(set(rows)):
        word = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[A-Za-z0-9\x80-\U0010ffff]+", text)]
        for i in range(len(word) - n + 1):
            places[tuple(w for *_, w in word[i : i + n])].append((key, text, word[i][0], word[i + n - 1][1]))
    repeated = sorted((*x, len(v), x == min(v)) for v in places.values() if len(v) > 1 for x in v)
    out: list[list] = []
    for key, text, start, end, copies, first in repeated:
        if out and out[-1][:2] == [key, text] and start <= out[-1][3]:
            one = out[-1]
            one[3:] = [end, one[4] + 1, max(one[5], copies), one[6] or first]
        else:
            out.append([key, text, start, end, 1, copies, first])
    return {(k, *x) for k, _, *x in out}


def found_spans(df, **options):
    return {tuple(r) for r in substring_dedup.repeated_spans(df, **options).collect()}


def test_repeated_spans(docs_of, rng):
    rows, shared = passages(rng)
    df = docs_of(rows)
    want = spans_of_all_windows([(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None and r.text], substring_dedup.WORDS)
    got = found_spans(df, chunk_bytes=2000)
    assert got == want == found_spans(df)
    found = {k for k, *_ in got}
    assert found >= set(range(40)) | {200}
    assert not found & set(range(100, 120))
    firsts = {s: min(i for i, t in rows if s in t) for s in shared}
    assert {k for k, *_, first in got if first} >= set(firsts.values()) - {200}


def test_collisions_lose_nothing(docs_of, rng):
    df = docs_of(passages(rng)[0])
    plain = found_spans(df)
    assert plain == found_spans(df, load=1e-3, depth=1, chunk_bytes=3000)
    assert plain == found_spans(df, load=0.1, depth=3)


@pytest.mark.parametrize("n", [40, 45, 60])
def test_every_repeated_window_is_in_a_span(docs_of, rng, n):
    rows = []
    for length in range(n - 1, n + 12):
        passage = words(rng, length)
        rows += [(len(rows), f"{words(rng, 30)} {passage} {words(rng, 20)}"), (len(rows) + 1, f"{words(rng, 7)}, {passage.upper()}. {words(rng, 60)}")]
    got = found_spans(docs_of(rows, odd=False), words=n, chunk_bytes=4000)
    assert len(got) == 24
    assert got == spans_of_all_windows(rows, n)


def test_one_key_with_two_texts(spark, rng):
    passage = words(rng, 50)
    rows = [(1, passage + " " + words(rng, 9)), (1, words(rng, 9) + " " + passage), (2, words(rng, 80)), (2, words(rng, 80))]
    got = found_spans(spark.createDataFrame(rows * 2, "doc_id long, text string"))
    assert {x[:-1] for x in got} == {x[:-1] for x in spans_of_all_windows(rows, substring_dedup.WORDS)}
    assert sorted(x[-1] for x in got) == [False, True]


def test_sketches_add_up_and_are_never_too_low():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 300, m).astype(np.uint64) for m in (500, 1, 900, 40)]
    true = Counter(np.concatenate(parts).tolist())
    for depth, width in ((2, 7), (1, 64), (3, 1 << 12), (2, 1 << 21)):
        sketches = [substring_dedup.sketch(p, depth, width) for p in parts]
        for p, (cells, _), bits in zip(parts, sketches, substring_dedup.added(sketches, depth * width), strict=True):
            many = set(cells[bits].tolist())
            marked = [all(int(substring_dedup.cells_of(np.array([v], np.uint64), d, width)[0]) in many for d in range(depth)) for v in p]
            assert all(m for m, v in zip(marked, p.tolist(), strict=True) if true[v] > 1)
            if width > 1 << 20:
                assert marked == [true[v] > 1 for v in p.tolist()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = con.execute(queries.ORACLE_SQL[name])
    names = sorted(c[0] for c in got.description)
    assert names == sorted(df.columns)
    order = [[c[0] for c in got.description].index(n) for n in names]
    want = Counter(tuple(r[i] for i in order) for r in got.fetchall())
    assert Counter(tuple(r[n] for n in names) for r in df.collect()) == want
