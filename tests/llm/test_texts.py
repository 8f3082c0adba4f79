"""Operators that look at one text at a time, against slow versions."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from glyphsieve.llm import decontaminate, langid, pii, queries, winnow
from glyphsieve.llm.shared import read
from tests.llm.conftest import words

SF = "/root/testdata/sf0.001"


def slow_winnow(text, k, window):
    chars = [(i, c.lower()) for i, c in enumerate(text) if (c.isascii() and c.isalnum()) or ord(c) > 127]
    hashes = []
    for i in range(len(chars) - k + 1):
        h = 0
        for _, c in chars[i : i + k]:
            h = (h * winnow.BASE + ord(c)) % winnow.PRIME
        hashes.append(h)
    found = set()
    for i in range(max(1, len(hashes) - window + 1) if hashes else 0):
        part = hashes[i : i + window]
        best = max(j for j, h in enumerate(part) if h == min(part))
        found.add((hashes[i + best], chars[i + best][0]))
    return found


@pytest.mark.parametrize(("k", "window"), [(1, 1), (5, 4), (8, 13), (25, 40)])
def test_winnowing(spark, docs_of, rng, k, window):
    rows = [(i, words(rng, n, "abÉé")) for i, n in enumerate((1, 2, 7, 30, 200, 60))] + [(50, "ab" * 500), (51, "Ünïcödé \U0001f600 " * 40)]
    df = docs_of(rows)
    got = [tuple(r) for r in winnow.fingerprints(df, k=k, window=window).collect()]
    want = [(r.doc_id, h, p) for r in df.collect() for h, p in slow_winnow(r.text or "", k, window)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_winnowing_guarantee_and_pieces(monkeypatch, rng):
    monkeypatch.setattr(winnow, "PIECE", 64)
    text = words(rng, 400)
    data = np.frombuffer(text.encode(), np.uint8)
    row, value, place = winnow.fingerprints_of(data, np.array([0, len(data)]), 6, 9)
    assert set(zip(value.tolist(), place.tolist(), strict=True)) == slow_winnow(text, 6, 9)


def test_winnowing_of_nothing(empty):
    assert winnow.fingerprints(empty).count() == 0


def slow_match(pattern, text, budget):
    """(start, end, edits) of the part of the text that is nearest to the pattern: earliest end, leftmost start; None beyond the budget."""
    row = [(0, j) for j in range(len(text) + 1)]  # (edits, start) by end
    for i, p in enumerate(pattern, 1):
        new = [(i, 0)]
        for j, t in enumerate(text, 1):
            step, drop, more = row[j - 1], row[j], new[-1]
            new.append(min((step[0] + (p != t), step[1]), (drop[0] + 1, drop[1]), (more[0] + 1, more[1])))
        row = new
    edits = min(e for e, _ in row)
    end = next(j for j, (e, _) in enumerate(row) if e == edits)
    return (row[end][1], end, edits) if edits <= budget else None


def slow_contaminated(rows, items):
    """All matches: the nearest one, and those left and right of it, in characters of the text."""
    out = []
    for k, text in rows:
        words_at = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[A-Za-z0-9\x80-\U0010ffff]+", text or "")]
        plain, begins, ends = "", [], []
        for s, e, w in words_at:
            if plain:
                plain, begins, ends = plain + " ", [*begins, ends[-1]], [*ends, ends[-1] + 1]
            plain, begins, ends = plain + w, begins + list(range(s, e)), ends + list(range(s + 1, e + 1))
        for i, item in items:
            item = " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", item.lower()))
            todo = [(0, len(plain))]
            while todo:
                low, high = todo.pop()
                if m := slow_match(item, plain[low:high], decontaminate.budget(len(item), decontaminate.Q, decontaminate.RATE)):
                    s, e = low + m[0], low + m[1]
                    out.append((k, i, begins[s], ends[e - 1], m[2]))
                    todo += [(low, s), (e, high)]
    return sorted(out, key=repr)


def test_decontamination(spark, docs_of, rng):
    items = [words(rng, 14) for _ in range(6)]
    rows = []
    for i in range(60):
        text = words(rng, 40)
        if i % 2:
            planted = list(items[i % 6])
            for _ in range(i % 9):
                at = rng.randrange(len(planted))
                planted[at : at + 1] = rng.choice([["z"], [], [planted[at], "q"]])
            text = words(rng, 9) + ". " + "".join(planted).upper() + "! " + text
        if i % 10 == 3:
            text += ", " + items[i % 6] + " " + words(rng, 12)
        rows.append((i, text))
    df = docs_of(rows)
    plain = [(r.doc_id, r.text) for r in df.collect()]
    bench = spark.createDataFrame([*enumerate(items), (70, None), (None, items[0]), (71, "short"), (72, items[0])], "item_id long, text string")
    want = slow_contaminated(plain, [*enumerate(items), (72, items[0])])

    def found(**options):
        return sorted([tuple(r) for r in decontaminate.contaminated(df, bench, **options).collect()], key=repr)

    got = found()
    assert {x[:2] for x in got} == {x[:2] for x in want}
    assert len(got) == len(want) > 20
    for (*_, s, e, edits), (*_, ws, we, w) in zip(got, want, strict=True):
        assert edits == w
        assert e == we
        assert s == ws
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns
    hit = {k for k, *_ in want}
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in df.collect() if r.doc_id not in hit)
    assert found(shard_chars=50, pass_shards=2) == got
    assert decontaminate.clean(df, bench, shard_chars=50, pass_shards=2).count() == kept.count()
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0
    assert decontaminate.clean(df.limit(0), bench).count() == 0


def test_checksums():
    assert pii.luhn("4111 1111 1111 1111")
    assert not pii.luhn("4111 1111 1111 1112")
    assert not pii.luhn("0000 0000 0000 0000")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32")
    assert not pii.mod97("GB82 WEST 1234 5698 7654 33")


def test_private_data(docs_of):
    text = "Write to ann.lee@example.org or call +49 30 1234567. Card 4111-1111-1111-1111, IBAN DE89 3704 0044 0532 0130 00, from 10.0.0.1."
    df = docs_of([(1, text), (2, "order 4111111111111112 of version 1.2.3.4"), (3, "é" * 1000 + " a@b.cd " + "x " * 50000), (4, "nothing here")])
    kinds = {}
    for r in pii.private_spans(df).collect():
        kinds.setdefault(r.doc_id, set()).add(r.kind)
    assert kinds[1] == {"EMAIL", "PHONE", "CARD", "IBAN", "IPV4"}
    assert kinds[3] == {"EMAIL"}
    assert 2 not in kinds
    assert 4 not in kinds
    out = pii.masked_documents(df)
    assert out.columns == df.columns
    assert out.count() == df.count()
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[4].text == "nothing here"
    assert rows[9001].text is None
    assert rows[1].text.startswith("Write to [EMAIL] or call [PHONE]. Card [CARD], IBAN [IBAN]")
    assert rows[1].n_chars == len(rows[1].text)


@pytest.mark.parametrize(
    ("text", "rest"),
    [
        ("token=" + "eyJhbGci.Oi_J-" * 40 + " next", "[SECRET] next"),
        ("password=Pa$$word123 next", "[SECRET] next"),
        ("pwd: longer-than-8&and#more*signs%in$it. Next", "[SECRET] Next"),
        ("secret = abcdefgh1### next &&&", "[SECRET]### next &&&"),
        ("api_key='abc$defgh&&' next", "[SECRET] next"),
        ("{'a': 'token=abcdefgh1'}", "{'a': '[SECRET]}"),
        ("password=ab'cd\"efghij next", "[SECRET] next"),
        ("token: ### $$$ &&&&&&&&&& next", "token: ### $$$ &&&&&&&&&& next"),
    ],
)
def test_whole_values_are_masked(spark, text, rest):
    assert pii.masked_documents(spark.createDataFrame([(text,)], "text string")).first().text == rest


def with_check_digit(body):
    """The body and the digit that the Luhn check wants."""
    return next(body + d for d in "0123456789" if (sum(int(c) for c in (body + d)[-1::-2]) + sum(sum(map(int, str(2 * int(c)))) for c in (body + d)[-2::-2])) % 10 == 0)


def iban(country, rest):
    left = int("".join(str(int(c, 36)) for c in f"{rest}{country}00"))
    return f"{country}{98 - left % 97:02d}{rest}"


def test_planted_data(spark, docs_of, rng):
    """Spans, scores and masks of texts made of known parts, worked out by the parts alone."""
    own = {"EMAIL": "mail", "CARD": "visa", "IBAN": "konto", "PHONE": "call", "IPV4": "host", "SSN": "social"}
    base = {"EMAIL": 0.9, "CARD": 0.9, "IBAN": 0.95, "PHONE": 0.65, "IPV4": 0.75, "SSN": 0.65}

    def digits(n):
        return "".join(rng.choice("123456789") for _ in range(n))

    def make(kind, good):
        if kind == "EMAIL":
            return f"{words(rng, 1)}.{digits(2)}@{words(rng, 1)}.org" if good else f"{words(rng, 1)}@{words(rng, 1)}"
        if kind == "CARD":
            number = with_check_digit("4" + digits(14))
            number = number if good else number[:-1] + str((int(number[-1]) + 3) % 10)
            return rng.choice([number, " ".join(number[i : i + 4] for i in range(0, 16, 4))])
        if kind == "IBAN":
            country, n = rng.choice([("DE", 18), ("AT", 16), ("BE", 12)])
            code = iban(country, digits(n))
            code = code if good else code[:-1] + str(int(code[-1]) % 9 + 1)
            return code if not good else rng.choice([code, " ".join(code[i : i + 4] for i in range(0, len(code), 4))])
        if kind == "PHONE":
            return f"({digits(3)}) {digits(3)}-{digits(4)}" if good else f"({digits(3)}) {digits(2)}-{digits(4)}"
        if kind == "IPV4":
            return ".".join(str(rng.randint(1, 255)) for _ in range(4)) if good else f"{rng.randint(256, 999)}.1.2.3"
        return f"{rng.choice('12345')}{digits(2)}-{digits(2)}-{digits(4)}" if good else f"9{digits(2)}-{digits(2)}-{digits(4)}"

    rows, want = [], []
    for i in range(200):
        text, out = "", []
        for _ in range(rng.randint(1, 5)):
            kind, good = rng.choice(list(own)), rng.random() < 0.7
            near, part = rng.random() < 0.5, make(kind, good)
            text += "zz " * 20 + (f"{own[kind]} " if near else f"x{own[kind]}x ")
            if good:
                out.append((kind, len(text), len(text) + len(part), round(min(1.0, base[kind] + 0.2 * near), 2), kind not in ("EMAIL", "PHONE")))
            text += part + " USA"[: rng.choice([0, 4])] + " zz" * 20 + " "
        rows.append((i, text))
        want += [(i, *x) for x in out]
    got = [tuple(r) for r in pii.private_spans(docs_of(rows, odd=False)).collect()]
    # a wrong card may hold what reads as a telephone number, and so on: only what was planted is compared
    assert set(want) <= set(got)
    assert len(set(got) - set(want)) < len(want) // 20
    masked = {r.doc_id: r.text for r in pii.masked_documents(docs_of(rows, odd=False)).collect()}
    for i, text in rows:
        for _, kind, s, e, *_ in sorted((x for x in got if x[0] == i), key=lambda x: -x[2]):
            text = text[:s] + f"[{kind}]" + text[e:]
        assert masked[i] == text


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("AT61 1904 3002 3457 3201 USA", [("IBAN", 0, 24)]),
        ("AT61 1904 3002 3457 3201USA", []),
        ("DE89370400440532013000 GB82 WEST 1234 5698 7654 32", [("IBAN", 0, 22), ("IBAN", 23, 50)]),
        ("ZZ61 1904 3002 3457 3202", []),
        ("the secret: everything", []),
        ("the secret: everything2", [("SECRET", 4, 23)]),
        ("the secret='everything'", [("SECRET", 4, 23)]),
        ("", []),
    ],
)
def test_what_is_found(text, kinds):
    assert [(k, s, e) for s, e, k, *_ in pii.find(text) if k in ("IBAN", "SECRET", "CARD")] == kinds


def test_only_whole_words_near_by_count():
    for gap in range(30, 45):
        (score,) = [s[3] for s in pii.find("antisocial" + " " * gap + "123-45-6789") if s[2] == "SSN"]
        assert score == 0.65
        (score,) = [s[3] for s in pii.find("123-45-6789" + " " * gap + "socialism") if s[2] == "SSN"]
        assert score == 0.65
    assert pii.find("social" + " " * 34 + "123-45-6789")[0][3] == 0.85
    assert pii.find("social" + " " * 35 + "123-45-6789")[0][3] == 0.65


def test_no_private_data(empty):
    assert pii.private_spans(empty).count() == 0
    assert pii.masked_documents(empty).columns == empty.columns


def test_context_decides():
    plain = [s for s in pii.find("123-45-6789") if s[2] == "SSN"][0]
    near = [s for s in pii.find("my social security number is 123-45-6789") if s[2] == "SSN"][0]
    assert near[3] > plain[3]


def test_gradient():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in langid.init(3, 4, rng).items()}
    x, y = rng.integers(0, 256, (6, 5)), rng.integers(0, 3, 5)
    _, grad = langid.loss_and_gradient(p, x, y)
    for name in ("fU", "bc", "fO", "o", "bW"):
        at = tuple(rng.integers(0, s) for s in p[name].shape) if name != "bW" else (1, x[2, 1])
        old = p[name][at]
        p[name][at] = old + 1e-3
        high, _ = langid.loss_and_gradient(p, x, y)
        p[name][at] = old - 1e-3
        low, _ = langid.loss_and_gradient(p, x, y)
        p[name][at] = old
        assert abs((high - low) / 2e-3 - grad[name][at]) < 1e-3 * max(1, abs(grad[name][at])) + 1e-4


def test_language_of_held_out_documents(spark):
    rows = [r for r in read(spark, SF, "documents").collect() if r.text and r.lang]
    train, held = [r for r in rows if r.doc_id % 2], [r for r in rows if r.doc_id % 2 == 0]
    model = langid.train([r.text[:2000] for r in train], [r.lang for r in train])
    found = langid._result(langid.Network(model), pa.array([r.text for r in held]), 0.4).to_pylist()
    assert np.mean([f["language"] == r.lang for f, r in zip(found, held, strict=True)]) > 0.9
    for f, r in zip(found, held, strict=True):
        assert [s["start"] for s in f["spans"]] == [0, *(s["end"] for s in f["spans"][:-1])]
        assert f["spans"][-1]["end"] == len(r.text)


def test_language_edge_cases(docs_of, empty, rng):
    df = docs_of([(i, words(rng, 30, "abc" if i % 2 else "xyzé"), "aa" if i % 2 else "zz", "src0", 1) for i in range(40)] + [(99, "abc " * 30000, "aa", "s", 1)])
    rows = {r.doc_id: r for r in langid.detect_languages(df, langid.fit(df, steps=40)).collect()}
    assert rows[1].language == "aa"
    assert rows[2].language == "zz"
    assert rows[99].language == "aa"
    assert rows[9001].language is None
    assert not rows[9002].accepted
    assert langid.fit(empty) is None
    assert langid.accepted(df, None).count() == df.filter("text <> ''").count()
    assert langid.accepted(df, langid.fit(df, steps=40)).columns == df.columns


def slow_labels(model, data):
    """Probabilities at every byte, one step after the other, segment by segment."""

    def run(d, x):
        W, U, c, H = model[d + "W"], model[d + "U"], model[d + "c"][:, 0], model[d + "U"].shape[1]
        h, states = np.zeros(H), []
        for byte in x:
            a, g = U @ h, W[:, byte]
            z, r = (1 / (1 + np.exp(-(g[i : i + H] + a[i : i + H]))) for i in (0, H))
            n = np.tanh(g[2 * H :] + r * (a[2 * H :] + c))
            h = n + z * (h - n)
            states.append(h)
        return states

    padded = [10] * langid.CONTEXT + list(data) + [10] * (langid.CONTEXT + langid.SEGMENT)
    out = []
    for s in range(0, len(data), langid.SEGMENT):
        m = min(langid.SEGMENT, len(data) - s)
        f = run("f", padded[s : s + langid.CONTEXT + m])[langid.CONTEXT :]
        b = run("b", padded[s + langid.CONTEXT : s + 2 * langid.CONTEXT + m][::-1])[langid.CONTEXT :][::-1]
        for x, y in zip(f, b, strict=True):
            e = np.exp(model["fO"] @ x + model["bO"] @ y + model["o"][:, 0])
            out.append(e / e.sum())
    return np.array(out)


def test_inference_against_single_steps(rng):
    model = langid.train(["der die das und " * 20, "the of and to " * 20, "el la los que " * 20], ["de", "en", "es"], steps=30)
    texts = [words(rng, n, "abcdé") + rng.choice(["", " 日本"]) for n in (1, 3, 60, 75, 200)]
    got = langid._result(langid.Network(model), pa.array(texts), 0.4).to_pylist()
    for text, found in zip(texts, got, strict=True):
        data = text.encode()
        prob = slow_labels(model, data)
        assert np.allclose(found["probabilities"], prob.mean(0), atol=1e-4)
        assert found["language"] == model["names"][int(prob.mean(0).argmax())]
        label, lead = prob.argmax(1), [i for i, c in enumerate(data) if c & 0xC0 != 0x80]
        spread = [s["language"] for s in found["spans"] for _ in range(s["start"], s["end"])]
        sure = [np.sort(prob[i])[-1] - np.sort(prob[i])[-2] > 1e-3 for i in lead]
        assert all(a == model["names"][label[i]] for a, i, on in zip(spread, lead, sure, strict=True) if on)
        assert len(spread) == len(text)


def test_a_repeated_row_decides_nothing(spark, rng):
    rows = [(words(rng, 40, "abc" if i % 2 else "xyz"), "aa" if i % 2 else "zz") for i in range(600)]
    copies = spark.range(40_000).selectExpr("'only one text of its kind' AS text", "'aa' AS lang")
    df = spark.createDataFrame(rows, "text string, lang string").unionByName(copies)
    texts, labels = langid.sample(df, "text", "lang", 300, 60, 7)
    assert labels.count("aa") == labels.count("zz") == 150
    assert sum(t.startswith("only one") for t in texts) <= 1
    assert (texts, labels) == langid.sample(df.repartition(5), "text", "lang", 300, 60, 7)
    model = langid.fit(df, sample_pieces=300, piece_chars=60, steps=40)
    found = langid._result(langid.Network(model), pa.array([t for t, _ in rows]), 0.4).to_pylist()
    assert np.mean([f["language"] == y for f, (_, y) in zip(found, rows, strict=True)]) > 0.95


def test_many_languages(spark, rng):
    names = [f"l{i:03d}" for i in range(200)]
    df = spark.createDataFrame([(i, words(rng, 30), names[i % 200]) for i in range(400)], "doc_id long, text string, lang string")
    model = langid.fit(df, steps=2)
    assert model["names"] == names
    got = langid.detect_languages(df, model).collect()
    assert len(got) == 400
    assert all(len(r.probabilities) == 200 and {s.language for s in r.spans} <= set(names) for r in got)


def test_what_is_in_no_declared_language_is_rejected(rng):
    rows = [r for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist() if r["text"] and r["lang"]]
    unseen = ["широкая электрификация южных губерний даст мощный толчок подъёму", "kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。"]
    junk = ["#### $$$ &&& ;; ;; -- == " * 10, "12 4 8829 - 17", "".join(chr(rng.randint(33, 126)) for _ in range(400)), "".join(rng.sample(rows[0]["text"] * 3, 300))]
    for names in (["en"], ["en", "de"], ["de", "en", "es", "fr"]):
        own = [r for r in rows if r["lang"] in names]
        model = langid.train([r["text"][:600] for r in own[::2]], [r["lang"] for r in own[::2]], steps=80)
        found = langid._result(langid.Network(model), pa.array([*unseen, *junk, *(r["text"] for r in own[1::2])]), 0.4).to_pylist()
        assert not any(f["accepted"] for f in found[: len(unseen) + len(junk)])
        assert np.mean([f["accepted"] for f in found[len(unseen) + len(junk) :]]) > 0.95
        if len(names) < 4:
            others = [r["text"] for r in rows if r["lang"] not in names and len(r["text"]) > 100]
            assert np.mean([f["accepted"] for f in langid._result(langid.Network(model), pa.array(others), 0.4).to_pylist()]) < 0.1


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_runs(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.count() > 0
    assert any(c in df.columns for c in ("doc_id", "docs", "conversations", "page_id"))


