"""The pipeline's stages and the whole of it against slow versions, and its entry."""

from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline
from glyphsieve.llm import langid, mixing, ngram_join, textops
from tests.llm.conftest import words
from tests.llm.test_sets import slow_partners
from tests.llm.test_texts import slow_contaminated, slow_labels
from tests.llm.test_trees import slow_mix


def slow_accepted(model, text, least=0.4):
    """One byte after the other: the network's mean probabilities, and how familiar the trigrams are."""
    if not text:
        return False
    data = text.encode()
    low = [b + 32 if 65 <= b <= 90 else b for b in data]
    low = [b | 0x20 if i and low[i - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97 else b for i, b in enumerate(low)]
    signs = [32]
    for b in low:
        b = b if 97 <= b <= 122 or b >= 128 else 32
        if b != 32 or signs[-1] != 32:
            signs.append(b)
    signs.append(32)
    known = []
    for a, b, c in zip(signs, signs[1:], signs[2:], strict=False):
        if b != 32:
            h = (a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA77 & 0xFFFFFFFF) ^ (c * 0xC2B2AE3D & 0xFFFFFFFF)
            known.append(model["known"][h >> 7 & 0xFFFF])
    familiar = known and np.mean(known) >= model["floor"] - langid.SHORT / np.sqrt(len(known))
    return bool(familiar and slow_labels(model, data).mean(0).max() >= least)


def write(spark, folder, df, bench):
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    df.write.parquet(str(folder / "documents.parquet"))


def test_stages_and_the_whole_run(spark, docs_of, rng, tmp_path):
    bench = [(i, words(rng, 14)) for i in range(3)]
    copied = words(rng, 60, "abcd")
    rows = [(i, words(rng, 40, "abcd" if i % 2 else "wxyz"), "aa" if i % 2 else "zz", f"src{i % 4}", 1) for i in range(60)]
    rows += [(100 + i, copied + f" tail{'abcd'[i]}", "aa", "src1", 1) for i in range(4)]
    rows += [(200, words(rng, 20, "abcd") + " " + bench[1][1], "aa", "src2", 1), (201, words(rng, 30, "abcd") + " mail ann@example.org", None, "src3", 9), (202, "#### 1 2 3 $$$$ " * 9, "aa", "src3", 9)]
    df = docs_of(rows)
    write(spark, tmp_path, df, bench)
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, before, str(tmp_path)).write.parquet(str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
        seen[name] = docs.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == df.columns

    # the same, slowly
    rows = df.collect()
    model = langid.fit(spark.read.parquet(str(tmp_path / "documents.parquet")))
    rows = [r for r in rows if slow_accepted(model, r.text)]
    assert Counter(seen["language_id"]) == Counter(rows)
    assert {r.doc_id for r in rows} >= set(range(60))
    assert not {r.doc_id for r in rows} & {202, 9001, 9002, 9003}
    found = slow_partners([(r.doc_id, r.text) for r in rows], ngram_join.N, ngram_join.THRESHOLD)
    rows = [r for r in rows if r.doc_id not in found or found[r.doc_id][0] == r.doc_id]
    assert Counter(seen["near_duplicates"]) == Counter(rows)
    assert not {r.doc_id for r in rows} & {101, 102, 103}
    bad = {k for k, *_ in slow_contaminated([(r.doc_id, r.text) for r in rows], bench)}
    rows = [r for r in rows if r.doc_id not in bad]
    assert bad == {200}
    assert Counter(seen["benchmark_decontamination"]) == Counter(rows)
    masked = [(r.doc_id, r.text.replace("ann@example.org", "[EMAIL]"), r.lang, r.source) for r in rows]  # nothing else in these texts is private
    assert Counter((r.doc_id, r.text, r.lang, r.source) for r in seen["private_data"]) == Counter(masked)
    assert all(r.n_chars == len(r.text) for r in seen["private_data"])
    want = Counter((k, e) for k, e, _ in slow_mix(masked, mixing.TREE, mixing.PERCENT, mixing.MAX_EPOCHS, mixing.SEED))
    assert Counter((r.doc_id, r.epoch) for r in seen["source_mixing"]) == want
    assert len(want) > 10
    assert Counter((r.doc_id, r.epoch) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_stages_do_no_more_than_they_keep(rng, monkeypatch):
    """No grams go through np.unique's hashing, which took most of the second stage's time; the first makes no labels."""
    plain = np.unique

    def watched(values, **options):
        assert options or len(plain(values)) < 1000
        return plain(values, **options)

    texts = [words(rng, 400) for _ in range(40)]
    texts += [f"{t} tail{i}" for i, t in enumerate(texts)] + [None, "", "two words"]
    with monkeypatch.context() as m:
        m.setattr(np, "unique", watched)
        row, gram = (np.concatenate(x) for x in zip(*((r, g) for r, g, _, _ in ngram_join.gram_sets(pa.array(texts), 3)), strict=True))
        assert len(gram) > 20_000
        assert all(np.all(np.diff(gram[row == r].astype(np.int64)) > 0) for r in range(83))
        sent = list(ngram_join._send(5, np.arange(83), row, gram, 3))
        back = list(ngram_join._found_elsewhere(iter(sent)))
        alive = np.concatenate([b.column(0).to_numpy() for b in ngram_join._alive(0.6)(iter(back))])
        assert sorted(alive) == list(range(80))
        row, gram = row[row < 80], gram[row < 80]
        n = np.bincount(row)
        assert len(plain(ngram_join.groups(row, gram, n, ngram_join.signatures(row, gram, n), 0.6))) == 40

    def no_spans(*_):
        raise AssertionError("spans are for op8 alone")

    network = langid.Network(langid.train([words(rng, 99, "abcd"), words(rng, 99, "wxyz")], ["a", "z"], steps=20))
    some = pa.array([None, "", "## 1", *(words(rng, k, "abcdwxyz") for k in (1, 3, 50, 900)), "qqq kkk"])
    want = langid._result(network, some, 0.55).field("accepted")
    monkeypatch.setattr(langid, "spans_of", no_spans)
    assert langid._kept(network, some, 0.55).equals(want)
    assert langid._kept(None, some, 0.55).to_pylist() == [False, False] + [True] * 6


def test_ascending_is_the_stable_order():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) << np.uint64(1)
    values[::7] = values[3]
    values[1::50] = (values[1::50] & ~np.uint64(0xFFFFFF)) | rng.integers(0, 1 << 13, 100, dtype=np.uint64)
    values[2:4000:100] = values[3] ^ rng.integers(0, 4, 40, dtype=np.uint64)  # these differ in the last bits only
    for v in (values, values[:1], values[:0], values & np.uint64(7)):
        assert np.array_equal(textops.ascending(v), np.argsort(v, kind="stable"))
        assert np.array_equal(textops.distinct(v), np.unique(v))


def test_near_duplicates_meet_and_no_chain_of_others(spark, rng, tmp_path, monkeypatch):
    """Each text has half of the next one; among them are a few near copies."""
    piece = [words(rng, 20) for _ in range(61)]
    rows = [(i, f"{piece[i]} {piece[i + 1]}") for i in range(60)] + [(100 + i, f"{piece[9]} {piece[10]} tail{i}") for i in range(3)]
    plain = ngram_join._meet

    def watched(threshold, orders):
        meet = plain(threshold, orders)

        def see(table):
            (tmp_path / str(table["rid"][0])).write_text(str(len(table)))
            return meet(table)

        return see

    monkeypatch.setattr(ngram_join, "_meet", watched)
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))
    assert max(int(f.read_text()) for f in tmp_path.iterdir()) < 10


def test_an_empty_table_and_nulls_everywhere(spark, empty, tmp_path):
    bench = [(1, "one item of a benchmark that stands in no text here")]
    write(spark, tmp_path, empty, bench)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2 + [(1, "a few words", None, None, None)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, nulls, str(tmp_path))
        assert set(nulls.columns) <= set(out.columns)
        assert out.count() <= 4


def test_whole_run(spark):
    df = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "text", "lang", "source", "n_chars", "epoch"} == set(df.columns)
    assert df.count() > 0
