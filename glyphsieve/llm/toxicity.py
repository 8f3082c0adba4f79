"""Toxicity: a support vector machine with a subsequence string kernel.

The kernel counts the subsequences of three letters that two words share, each
weighted by ``DECAY`` to the length it spans in both. A gap or an inserted letter
makes it smaller, not zero. Its sum over the words of two sentences, divided by the
root of their numbers, is a kernel of sentences. The machine works on Nyström features:
kernel values with landmark words, times the inverse root of the landmarks' kernel
matrix. Once trained, landmarks and weights fold into one table over letter triples,
from which any word's decision value follows exactly.

What it reads are units: words (letters, with digits and signs that stand for
letters), letters that stand alone one after another ("i d i o t"), and words joined
by a single sign ("id-iot"). A unit of more than ``LONG`` letters is read in windows of
so many that overlap by half. A text's value is that of its worst unit.

Training takes labelled sentences: those of ``sample_docs`` different texts of each
label at most, whole ones, ``sample_chars`` characters of each label together at most.
A sentence inherits its text's label.

1. Landmarks: half are words with four neighbouring letters that the labels' texts
   have most unequally often, half are words of clean texts.
2. A machine is trained on all sentences with the sentences' kernel.
3. As only some sentences of a toxic text are toxic, and in them only some words, the
   machine is trained again, by ``rounds``, as one of multiple instances: of each toxic
   text the word that it finds worst, and what else it finds toxic that stands in several
   toxic texts and hardly in clean ones, with copies of them that have a letter inserted,
   against words of clean texts, the worst above all. A word costs as many
   texts as blame it, or as are clean and have it.

Defined results:

* a null or empty text has value 0.0, isn't toxic, and has no place (null); a null key
  gets its row as any other; very long texts are read whole;
* without labelled texts of both kinds no text is toxic; texts of more than
  ``sample_chars`` characters aren't learnt from;
* values below the decision boundary are given as 0.0; of equal units the first
  is reported; positions are characters of the text;
* repeated rows each get their result, but count once in training; a key with several
  texts labels all of them; a key with both labels labels its texts as both; labels of
  unknown keys, null labels and null keys are ignored;
* other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphsieve.llm.shared import written
from glyphsieve.llm.textops import U64, buffers, char_index, slices, span_hashes

DECAY = 0.6
LONG = 24
SHORT = 3
LETTERS = 64
#: Directions of the landmarks in which their kernel matrix is below this share of its largest are left out.
LEAST_PART = 1e-4
SCHEMA = "toxic boolean, score double, start int, end int"
FIELDS = [pa.field("toxic", pa.bool_()), pa.field("score", pa.float64()), pa.field("start", pa.int32()), pa.field("end", pa.int32())]

#: A letter's number by byte; LEAD begins a non-ASCII letter, whose later bytes give its numbers; NONE is in no word.
LEAD, NONE = 254, 255
_LETTER = np.full(256, NONE, np.uint8)
_LETTER[97:123] = _LETTER[65:91] = np.arange(26)
for _sign, _as in zip("013457@$", "oieastas", strict=True):
    _LETTER[ord(_sign)] = ord(_as) - 97
_LETTER[0xC0:0x100] = LEAD
_LETTER[0x80:0xC0] = 26 + (np.arange(64) & 0x1F)  # capitals of Latin-1 are 32 below their small letters
_PROPER = np.zeros(256, dtype=bool)
_PROPER[[*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]] = True
_JOIN = np.zeros(256, dtype=bool)
_JOIN[[ord(c) for c in "._-*'~|+^"]] = True


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(letters, begin, length, row, first byte, end byte) of the units of UTF-8 rows: begin and length are places in letters."""
    none = np.zeros(0, np.int64)
    code = _LETTER[data]
    is_word = code != NONE
    if not is_word.any():
        return np.zeros(0, np.uint8), none, none, none, none, none
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[0], edge[-1] = is_word[0], is_word[-1]
    np.not_equal(is_word[1:], is_word[:-1], out=edge[1:-1])
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    inner = np.unique(cut[is_word[cut] & is_word[cut - 1]])
    at = np.flatnonzero(edge)
    if len(inner):
        at = np.sort(np.concatenate([at, inner, inner]))
    start, end = at[0::2], at[1::2]
    row = np.searchsorted(offsets, start, side="right") - 1
    is_letter = code < LEAD
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(is_letter, out=before[1:])
    letters = code[is_letter]
    n = before[end] - before[start]
    # a word goes on with the next one
    gap = start[1:] - end[:-1]
    on = (row[1:] == row[:-1]) & (gap > 0)
    between = np.where(gap == 1, data[np.minimum(end[:-1], len(data) - 1)], 10)
    alone = (n[1:] == 1) & (n[:-1] == 1) & (gap <= 3) & ~((gap == 1) & (between == 10))
    on &= ((gap == 1) & _JOIN[between]) | alone
    head = np.flatnonzero(np.r_[True, ~on])
    tail = np.append(head[1:], len(start)) - 1
    start, end, row = start[head], end[tail], row[head]
    begin = before[start]
    n = before[end] - begin
    proper = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_PROPER[data], out=proper[1:])
    keep = (n >= SHORT) & (proper[end] > proper[start])  # digits and signs alone are no word
    start, end, row, begin, n = (x[keep] for x in (start, end, row, begin, n))
    long = np.flatnonzero(n > LONG)
    if len(long):
        # windows that overlap by half; each carries the whole unit's place
        step = LONG // 2
        count = np.ones(len(n), np.int64)
        count[long] = -(-(n[long] - LONG) // step) + 1
        which = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        whole = n[which]
        off = np.minimum(k * step, np.maximum(whole - LONG, 0))
        begin, n = begin[which] + off, np.minimum(whole, LONG)
        start, end, row = start[which], end[which], row[which]
    return letters, begin, n, row, start, end


@lru_cache(maxsize=64)
def _triples(n: int) -> tuple[list[tuple[int, int, int, float]], float]:
    """(i, j, k, weight) of a word of n letters, and the sum of the squared weights."""
    out = [(i, j, k, DECAY ** (k - i + 1)) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n)]
    return out, sum(w * w for *_, w in out)


def weighted(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum over the triples of each word (rows of letters, all of one length) of decay times the table's entry (which may be a row)."""
    count, n = words.shape
    w = words.astype(np.int64)
    total = np.zeros((count, *table.shape[1:]))
    for i in range(n):
        for j in range(i + 1, n):
            pair = (w[:, i] * LETTERS + w[:, j]) * LETTERS
            part = None
            for k in range(j + 1, n):
                x = table[pair + w[:, k]]
                part = x * DECAY ** (k - i + 1) if part is None else part + x * DECAY ** (k - i + 1)
            if part is not None:
                total += part
    return total


def norms(words: np.ndarray) -> np.ndarray:
    """The root of each word's kernel with itself, by the kernel's recursion."""
    count, n = words.shape
    match = (words[:, :, None] == words[:, None, :]) * (DECAY * DECAY)
    prior = np.ones((count, n + 1, n + 1))
    for _ in range(2):
        now = np.zeros((count, n + 1, n + 1))
        for i in range(1, n + 1):
            run = np.zeros(count)
            for j in range(1, n + 1):
                run = DECAY * run + match[:, i - 1, j - 1] * prior[:, i - 1, j - 1]
                now[:, i, j] = DECAY * now[:, i - 1, j] + run
        prior = now
    return np.sqrt((match * prior[:, :n, :n]).sum((1, 2)))


def as_letters(word: str) -> np.ndarray:
    code = _LETTER[np.frombuffer(word.encode(), np.uint8)]
    return code[code < LEAD][:LONG]


def by_length(words: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, matrix of letters) of the words of each length."""
    size = np.array([len(w) for w in words])
    for n in np.unique(size):
        if n >= SHORT:
            at = np.flatnonzero(size == n)
            yield at, np.stack([words[i] for i in at])


def decide(words: list[np.ndarray], model: dict) -> np.ndarray:
    out = np.full(len(words), -np.inf)
    for at, matrix in by_length(words):
        out[at] = weighted(matrix, model["table"]) / norms(matrix) + model["bias"]
    return out


class Nystrom:
    """Features of words: kernel values with the landmarks, each word's own kernel value taken as 1, times the inverse root of the landmarks' matrix."""

    def __init__(self, marks: list[np.ndarray]):
        triples: list[int] = []
        row: list[int] = []
        weight: list[float] = []
        for m, w in enumerate(marks):
            for i, j, k, x in _triples(len(w))[0]:
                triples.append((int(w[i]) * LETTERS + int(w[j])) * LETTERS + int(w[k]))
                row.append(m)
                weight.append(x)
        self.ids, at = np.unique(triples, return_inverse=True)
        self.phi = np.zeros((len(self.ids) + 1, len(marks)), np.float32)  # the last row is of all other triples
        np.add.at(self.phi, (at, row), weight)
        self.phi /= np.maximum(np.linalg.norm(self.phi, axis=0), 1e-12)
        self.index = np.full(LETTERS**3, len(self.ids), np.int32)
        self.index[self.ids] = np.arange(len(self.ids))
        value, vector = np.linalg.eigh(self.phi.T.astype(float) @ self.phi)
        on = value > LEAST_PART * value.max()
        self.root = vector[:, on] / np.sqrt(value[on])

    def _sums(self, words: np.ndarray) -> np.ndarray:
        count, n = words.shape
        w = words.astype(np.int64)
        total = np.zeros((count, self.phi.shape[1]), np.float32)
        for i in range(n):
            for j in range(i + 1, n):
                pair = (w[:, i] * LETTERS + w[:, j]) * LETTERS
                for k in range(j + 1, n):
                    at = self.index[pair + w[:, k]]
                    hit = np.flatnonzero(at < len(self.ids))
                    if len(hit):
                        total[hit] += self.phi[at[hit]] * np.float32(DECAY ** (k - i + 1))
        return total

    def features(self, words: list[np.ndarray]) -> np.ndarray:
        """With a last column of ones, for the bias."""
        out = np.ones((len(words), self.root.shape[1] + 1), np.float32)
        for at, matrix in by_length(words):
            for i in range(0, len(at), 1024):
                part = matrix[i : i + 1024]
                out[at[i : i + 1024], :-1] = (self._sums(part) / norms(part)[:, None]) @ self.root
        return out

    def model(self, w: np.ndarray) -> dict:
        table = np.zeros(LETTERS**3, np.float32)
        table[self.ids] = self.phi[:-1] @ (self.root @ w[:-1])
        return {"table": table, "bias": float(w[-1])}


def machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float, steps: int = 30) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton's method; the last column of x is the bias. Rows are read in blocks."""
    w, penalty = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(steps):
        matrix, gradient = np.diag(penalty), -penalty * w
        for i in range(0, len(x), 8192):
            part, sign = x[i : i + 8192].astype(float), y[i : i + 8192]
            margin = 1 - sign * (part @ w)
            on = margin > 0
            part, weight = part[on], cost[i : i + 8192][on]
            matrix += (part * weight[:, None]).T @ part
            gradient += (weight * sign[on] * margin[on]) @ part
        step = np.linalg.solve(matrix, gradient)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


_SENTENCE = re.compile(r"[^.!?\n]+")


def sentences(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, in order of their hashes, then for each word of each sentence: word, sentence; text of each sentence)."""
    lines = [(i, s) for i, t in enumerate(texts) for s in _SENTENCE.findall(t)]
    data, offsets = buffers(pa.array([s for _, s in lines], pa.large_string()))
    known: dict[int, np.ndarray] = {}
    hashes, rows = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for i, j in slices(offsets):
        letters, begin, n, row, _, _ = units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        h = span_hashes(letters, begin, begin + n)
        for x, f in zip(*np.unique(h, return_index=True), strict=True):
            known.setdefault(int(x), letters[begin[f] : begin[f] + n[f]])
        hashes.append(h)
        rows.append(row + i)
    keys = np.array(sorted(known), U64)
    word = np.searchsorted(keys, np.concatenate(hashes))
    pair = np.unique(np.concatenate(rows) * max(1, len(keys)) + word)
    return [known[int(x)] for x in keys], pair % max(1, len(keys)), pair // max(1, len(keys)), np.array([i for i, _ in lines], np.int64)


def _quads(word: np.ndarray) -> np.ndarray:
    w = word.astype(np.int64)
    return np.unique(((w[:-3] * LETTERS + w[1:-2]) * LETTERS + w[2:-1]) * LETTERS + w[3:]) if len(w) > 3 else w[:0]


def landmarks(words: list[np.ndarray], word: np.ndarray, text: np.ndarray, n_toxic: int, n_clean: int, most: int) -> list[int]:
    """Which words are landmarks; word, text: the distinct words of each text, toxic texts first."""
    each = [_quads(w) for w in words]
    count = np.array([len(q) for q in each])
    kinds, quad = np.unique(np.concatenate([*each, np.zeros(0, np.int64)]), return_inverse=True)
    start = np.cumsum(count) - count
    a, b = np.full(len(kinds), 0.5), np.full(len(kinds), 0.5)
    edges = np.flatnonzero(np.r_[True, text[1:] != text[:-1], True])
    for s, e in zip(edges[:-1], edges[1:], strict=True):  # each text has a quad or not
        own = word[s:e]
        many = count[own]
        entry = np.repeat(start[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
        (a if text[s] < n_toxic else b)[np.unique(quad[entry])] += 1
    odds = np.log(a / (n_toxic + 1 - a)) - np.log(b / (n_clean + 1 - b))
    z = odds / np.sqrt(1 / a + 1 / b)
    in_toxic = np.bincount(word[text < n_toxic], minlength=len(words))
    in_clean = np.bincount(word[text >= n_toxic], minlength=len(words))
    # for each telling quad that no landmark has yet, the word with it that most toxic texts have
    of = np.repeat(np.arange(len(words)), count)
    by = np.lexsort((of, -in_toxic[of], quad))
    lead = of[by[np.searchsorted(quad[by], np.arange(len(kinds)))]]
    marks: list[int] = []
    covered = z <= 2
    for q in np.argsort(-z, kind="stable"):
        if len(marks) >= most // 2 or z[q] <= 2:
            break
        if not covered[q]:
            i = int(lead[q])
            covered[quad[start[i] : start[i] + count[i]]] = True
            marks.append(i)
    marks = list(dict.fromkeys(marks))
    taken = set(marks)
    clean = [int(i) for i in np.flatnonzero(in_clean) if int(i) not in taken]  # words come in order of their hashes
    return marks + clean[:: max(1, len(clean) // (most - len(marks)))][: most - len(marks)]


def train(toxic: list[str], clean: list[str], *, most_landmarks: int = 256, rounds: int = 5, negatives: int = 3000, seed: int = 3) -> dict | None:
    """A model from texts of both labels, or None without words of both."""
    toxic, clean = sorted(set(toxic)), sorted(set(clean))
    words, word, sentence, of = sentences(toxic + clean)
    text = np.unique(of[sentence] * max(1, len(words)) + word)
    text, in_text = text // max(1, len(words)), text % max(1, len(words))
    bad = text < len(toxic)
    if not bad.any() or bad.all():
        return None
    nystrom = Nystrom([words[i] for i in landmarks(words, in_text, text, len(toxic), len(clean), most_landmarks)])
    x = nystrom.features(words)

    # sentences with inherited labels
    cut = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
    run = np.diff(np.append(cut, len(sentence)))
    mean = np.empty((len(cut), x.shape[1]), np.float32)
    for i in range(0, len(cut), 4096):
        at = cut[i : i + 4096]
        end = cut[i + 4096] if i + 4096 < len(cut) else len(word)
        mean[i : i + 4096] = np.add.reduceat(x[word[at[0] : end]], at - at[0]) / np.sqrt(run[i : i + 4096])[:, None]
    mean[:, -1] = 1
    y = np.where(of[sentence[cut]] < len(toxic), 1.0, -1.0)
    w = machine(mean, y, len(y) / 2 / np.where(y > 0, (y > 0).sum(), (y < 0).sum()), ridge=10.0)
    del mean
    value = x[:, :-1] @ w[:-1]

    # words as instances
    rng = np.random.default_rng(seed)
    in_toxic, in_clean = (np.bincount(in_text[on], minlength=len(words)) for on in (bad, ~bad))
    own, first = in_text[bad], np.flatnonzero(np.r_[True, text[bad][1:] != text[bad][:-1]])
    pool = np.flatnonzero(in_clean)
    some = pool[:: max(1, len(pool) // negatives)]
    balance = (len(toxic) / len(clean)) ** 0.25
    # words that stand in several toxic texts and hardly in clean ones may be to blame beside a worse one
    known = np.flatnonzero((in_toxic > 2) & (in_toxic * len(clean) > 10 * in_clean * len(toxic)))
    for number in range(rounds):
        worst = np.repeat(np.maximum.reduceat(value[own], first), np.diff(np.append(first, len(own))))
        blamed = np.bincount(own[value[own] >= worst], minlength=len(words))
        if number:
            blamed[known] = np.where(value[known] > 0, in_toxic[known], blamed[known])
        positive = np.flatnonzero(blamed)
        variants = [np.insert(v, int(rng.integers(1, len(v))), rng.integers(0, 26))[:LONG] for i in positive for v in [words[i]] * 4]
        hard = pool[np.argsort(-value[pool], kind="stable")][:negatives]
        negative = np.union1d(some, hard)
        lot = np.concatenate([x[positive], nystrom.features(variants), x[negative]])
        y = np.r_[np.ones(len(positive) + len(variants)), -np.ones(len(negative))]
        cost = np.r_[blamed[positive], np.repeat(blamed[positive] * 0.1, 4), in_clean[negative] * balance]
        w = machine(lot, y, cost, ridge=1.0)
        value = x @ w
    return nystrom.model(w) | {"witnesses": len(positive)}


def values(data: np.ndarray, offsets: np.ndarray, model: dict) -> tuple[np.ndarray, ...]:
    """(row, score, first byte, end byte) of the units beyond the boundary, in order.

    A word's norm is at least that of its triples taken apart, a number that depends on its length alone; it
    bounds the value, so that norms are computed for few words."""
    letters, begin, n, row, start, end = units(data, offsets)
    score = np.zeros(len(n))
    if not len(n):
        return row, score, start, end
    h = span_hashes(letters, begin, begin + n)
    key = (h & ~U64(31)) | (n.astype(U64) & U64(31))
    _, first, at = np.unique(key, return_index=True, return_inverse=True)
    got = np.zeros(len(first))
    size = n[first]
    for length in np.unique(size):
        some = np.flatnonzero(size == length)
        words = letters[begin[first[some]][:, None] + np.arange(length)]
        top = weighted(words, model["table"])
        near = np.flatnonzero(top / np.sqrt(_triples(int(length))[1]) + model["bias"] > 0) if model["bias"] <= 0 else np.arange(len(some))
        if len(near):
            got[some[near]] = top[near] / norms(words[near]) + model["bias"]
    score = got[at]
    on = score > 0
    return row[on], score[on], start[on], end[on]


def _result(texts: pa.Array, model: dict | None) -> pa.Array:
    n = len(texts)
    best, place = np.zeros(n), np.zeros((2, n), np.int64)
    if model is not None:
        raw, bounds = buffers(texts)
        for i, j in slices(bounds, 1 << 20):
            data, offsets = raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            row, score, start, end = values(data, offsets, model)
            if not len(row):
                continue
            order = np.lexsort((start, -score, row))
            order = order[np.flatnonzero(np.r_[True, row[order][1:] != row[order][:-1]])]
            chars = char_index(data)
            r = row[order]
            best[i + r] = score[order]
            place[:, i + r] = chars[start[order]] - chars[offsets[r]], chars[end[order]] - chars[offsets[r]]
    toxic = best > 0
    return pa.StructArray.from_arrays([pa.array(toxic), pa.array(best), pa.array(place[0], pa.int32(), mask=~toxic), pa.array(place[1], pa.int32(), mask=~toxic)], fields=FIELDS)


def judge(model: dict | None):
    """An Arrow UDF from a text to a struct of SCHEMA."""

    @F.arrow_udf(SCHEMA)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _result(texts, model)

    return run


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_docs: int = 800, sample_chars: int = 8_000_000, seed: int = 3, **options) -> dict | None:
    """A model from at most ``sample_docs`` different texts of each label with ``sample_chars`` characters together: those of the least seeded hashes."""
    known = labels.select(labels[key].cast("long").alias("k"), labels[label].cast("int").alias("y")).filter("k is not null and y in (0, 1)").distinct()
    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t"), F.xxhash64(docs[text], F.lit(seed)).alias("h"), F.length(docs[text]).alias("n")).filter(F.col("n").between(1, sample_chars))
    # numbers first: which texts they are
    kinds = written(rows.select("k", "h", "n").join(known, "k").select("y", "h", "n").distinct())
    turn = Window.partitionBy("y").orderBy("h", "n").rowsBetween(Window.unboundedPreceding, 0)
    share = kinds.groupBy("y").count().select("y", F.least(F.lit(1.0), 4 * sample_docs / F.col("count")).alias("share"))
    near = kinds.join(F.broadcast(share), "y").filter(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < F.col("share") * (1 << 20) + 1)
    picked = near.withColumns({"turn": F.row_number().over(turn), "chars": F.sum("n").over(turn)}).filter((F.col("turn") <= sample_docs) & (F.col("chars") <= sample_chars)).select("y", "h")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[int, list[str]] = {0: [], 1: []}
        for b in batches:
            for y, t in zip(b.column("y").to_pylist(), b.column("t").to_pylist(), strict=True):
                texts[y].append(t)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts[1], texts[0], seed=seed, **options))])], ["model"])

    # the sample is bounded, so one task learns from it; the driver gets the model alone
    found = rows.select("t", "h").join(F.broadcast(picked), "h").dropDuplicates(["y", "h"]).select("y", "t").repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def judged(docs: DataFrame, model: dict | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, toxic, score, start, end) of every row; start and end: where its worst unit stands."""
    return docs.select(docs[key].alias("k"), judge(model)(docs[text]).alias("r")).select(F.col("k").alias(key), "r.*")
