"""Language ID: a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time, on a
bounded sample of rows with a declared language: ``sample_pieces`` pieces of
``piece_chars`` characters. All pieces of all texts stand the same chance, equal pieces
of a language count once, and languages take turns, so neither a repeated row nor a
frequent language decides the sample. The network labels every position of a text; the
probabilities of a document are the mean over its positions.

A text is cut into segments of ``SEGMENT`` bytes which run side by side as the
columns of one matrix; each direction is warmed up on ``CONTEXT`` bytes before
its segment. All bytes of all texts are labelled.

Softmax knows no 'none of these', and the best of K is 1/K at least. So a text is
accepted only if it also reads like the training texts: the mean log-probability of
its trigrams (letters folded, all else a space; of the languages the one that makes a
trigram likeliest) must reach a floor. It lies halfway between held-out pieces of the
training texts and the same with their letters scrambled, or ``SLACK`` below the
lowest held-out pieces (2 %) if that is less. It doesn't depend on K.

Defined results:

* null or empty text: language null, confidence 0.0, no spans, not accepted;
* a text without a letter (junk, signs, numbers) isn't accepted by a model;
* languages with less than two pieces of ``PIECE`` bytes to learn from set no floor;
* no row with a declared language to train on: language null, confidence 0.0,
  accepted (nothing can be rejected without a model);
* one declared language only: that language with confidence 1.0; there may be any
  number of languages (with more than sample_pieces of them, so many are learnt);
* a null key gets its row as any other; a very long text is read whole, in segments;
* repeated rows each get their row; ties between languages go to the language
  that sorts first; other columns are not read, whatever their names;
* an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphsieve.llm.shared import small, written
from glyphsieve.llm.textops import buffers, fold, lists, slices

HIDDEN = 8
#: The table of languages is broadcast up to so many bytes.
BROADCAST_BYTES = 32 << 20
SEGMENT = 256
CONTEXT = 32
#: Of the floor under which no text is accepted: bytes of a held-out piece, natural logarithms below the lowest of them, and what short texts are given over the root of their trigrams.
PIECE, SLACK, SHORT = 200, 2.0, 6.0
SCHEMA = (
    "language string, confidence double, accepted boolean, probabilities array<float>, "
    "spans array<struct<start:int,end:int,language:string>>"
)
ARROW = pa.struct(
    [
        ("language", pa.string()),
        ("confidence", pa.float64()),
        ("accepted", pa.bool_()),
        ("probabilities", pa.list_(pa.float32())),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("language", pa.string())]))),
    ]
)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def init(n_classes: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    p: dict[str, np.ndarray] = {}
    for d in "fb":
        p[d + "W"] = rng.normal(0, 0.3, (3 * hidden, 256))
        p[d + "U"] = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden))
        p[d + "c"] = np.zeros((hidden, 1))
        p[d + "O"] = rng.normal(0, 1 / np.sqrt(hidden), (n_classes, hidden))
    p["o"] = np.zeros((n_classes, 1))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _run(p: dict, d: str, x: np.ndarray) -> tuple[np.ndarray, list]:
    """States of one direction over x (T, B), and what backpropagation needs."""
    W, U, c = p[d + "W"], p[d + "U"], p[d + "c"]
    H = U.shape[1]
    h = np.zeros((H, x.shape[1]), np.float32)
    states, kept = np.empty((len(x), H, x.shape[1]), np.float32), []
    for t in range(len(x)):
        a = U @ h
        g = W[:, x[t]]
        zr = _sigmoid(g[: 2 * H] + a[: 2 * H])
        z, r = zr[:H], zr[H:]
        m = a[2 * H :] + c
        n = np.tanh(g[2 * H :] + r * m)
        new = n + z * (h - n)
        kept.append((h, z, r, m, n))
        states[t] = h = new
    return states, kept


def _back(p: dict, d: str, x: np.ndarray, kept: list, up: np.ndarray, grad: dict) -> None:
    """Backpropagation through time; up: the loss's gradient by each state."""
    U, H, W = p[d + "U"], p[d + "U"].shape[1], grad[d + "W"]
    gh = np.zeros_like(up[0])
    for t in range(len(x) - 1, -1, -1):
        h, z, r, m, n = kept[t]
        gh = gh + up[t]
        gn = gh * (1 - z) * (1 - n * n)
        gz = gh * (h - n) * z * (1 - z)
        gr = gn * m * r * (1 - r)
        gm = gn * r
        ga = np.concatenate([gz, gr, gm])
        gx = np.concatenate([gz, gr, gn])
        grad[d + "U"] += ga @ h.T
        grad[d + "c"] += gm.sum(1, keepdims=True)
        hot = np.zeros((x.shape[1], 256), np.float32)
        hot[np.arange(x.shape[1]), x[t]] = 1
        W += gx @ hot
        gh = gh * z + U.T @ ga


def loss_and_gradient(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over all positions of x (T, B) with labels y (B,)."""
    T, B = x.shape
    sf, kf = _run(p, "f", x)
    sb, kb = _run(p, "b", x[::-1])
    logits = p["fO"] @ sf + p["bO"] @ sb[::-1] + p["o"]
    logits -= logits.max(1, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(1, keepdims=True)
    at = prob[:, y, np.arange(B)]
    g = prob
    g[:, y, np.arange(B)] -= 1
    g /= T * B
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    grad["o"] += g.sum((0, 2))[:, None]
    grad["fO"] += np.einsum("tkb,thb->kh", g, sf)
    grad["bO"] += np.einsum("tkb,thb->kh", g, sb[::-1])
    _back(p, "f", x, kf, p["fO"].T @ g, grad)
    _back(p, "b", x[::-1], kb, (p["bO"].T @ g)[::-1], grad)
    return float(-np.log(np.maximum(at, 1e-12)).mean()), grad


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(16-bit hash, row) of the trigrams around each letter byte; runs of other bytes are one space."""
    low = fold(data)
    low = np.insert(np.where(_LETTER[low], low, np.uint8(32)), offsets, np.uint8(32))
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    d = low[keep].astype(np.uint32)
    at = np.flatnonzero(d[1:-1] != 32) + 1
    h = d[at - 1] * np.uint32(0x9E3779B1) ^ d[at] * np.uint32(0x85EBCA77) ^ d[at + 1] * np.uint32(0xC2B2AE3D)
    where = np.flatnonzero(keep)[at]  # offsets[i] + i is the space before row i
    return (h >> np.uint32(7)) & np.uint32(0xFFFF), np.searchsorted(offsets + np.arange(len(offsets)), where) - 1


def _likelihood(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + 0.05) / (counts.sum(1, keepdims=True) + 0.05 * counts.shape[1])).max(0).astype(np.float32)


def familiarity(known: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean log-probability, number) of each row's trigrams."""
    h, row = trigrams(data, offsets)
    n = np.bincount(row, minlength=len(offsets) - 1)
    return np.bincount(row, known[h], minlength=len(n)) / np.maximum(n, 1), n


def _known(by: list[np.ndarray], rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """(log-probability of each trigram, floor) from the bytes of each language. Pieces are judged by the other half of them."""

    def count(parts: list[np.ndarray]) -> np.ndarray:
        data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        return np.bincount(trigrams(data, np.cumsum([0, *map(len, parts)]))[0], minlength=1 << 16)

    pieces = [[b[i : i + PIECE] for i in range(0, len(b) - PIECE + 1, PIECE)] for b in by]
    floors = []
    half = [np.stack([count(x[k::2]) for x in pieces]) for k in (0, 1)]
    for x in pieces:
        true, mixed = [], []
        for k in (0, 1):
            if (own := x[k::2]) and len(x) > 1:
                known, ends = _likelihood(half[1 - k]), np.arange(len(own) + 1) * PIECE
                true.append(familiarity(known, np.concatenate(own), ends)[0])
                mixed.append(familiarity(known, np.concatenate([rng.permutation(o) for o in own]), ends)[0])
        if true:
            true, mixed = np.concatenate(true), np.concatenate(mixed)
            floors.append(min((np.median(true) + np.median(mixed)) / 2, np.quantile(true, 0.02) - SLACK))
        else:
            floors.append(-np.inf)
    return _likelihood(np.stack([count([b]) for b in by])), float(min(floors))


def train(texts: list[str], labels: list[str], *, hidden: int = HIDDEN, steps: int = 160, batch: int = 256, length: int = 48, seed: int = 7) -> dict | None:
    """A model, or None without a labelled text that isn't empty."""
    pairs = [(t.encode(), y) for t, y in zip(texts, labels, strict=True) if t and y is not None]
    if not pairs:
        return None
    names = sorted({y for _, y in pairs})
    rng = np.random.default_rng(seed)
    by = [b"\n".join(t for t, y in pairs if y == name) for name in names]
    known, floor = _known([np.frombuffer(b, np.uint8) for b in by], np.random.default_rng(seed))
    by = [np.frombuffer(b * (length // max(1, len(b)) + 1), np.uint8) for b in by]
    p = init(len(names), hidden, rng)
    if len(names) > 1:
        mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            y = rng.integers(0, len(names), batch)
            x = np.stack([by[k][(i := rng.integers(0, len(by[k]) - length + 1)) : i + length] for k in y], axis=1)
            _, grad = loss_and_gradient(p, x, y)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            rate = 0.03 * min(1, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                g *= min(1, 1 / (norm + 1e-9))
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                p[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return {"names": names, "known": known, "floor": floor, **p}


class Network:
    """A trained model laid out for inference: the gates' halving is in the weights."""

    def __init__(self, model: dict):
        self.names, H = model["names"], model["fU"].shape[1]
        half = np.ones((3 * H, 1), np.float32)
        half[: 2 * H] = 0.5
        self.hidden, self.bias = H, model["o"]
        self.known, self.floor = model["known"], model["floor"]
        self.table = {d: np.ascontiguousarray(model[d + "W"] * half) for d in "fb"}
        self.cross = {d: np.ascontiguousarray(model[d + "U"] * half) for d in "fb"}
        self.shift = {d: model[d + "c"] for d in "fb"}
        self.out = {d: np.ascontiguousarray(model[d + "O"]) for d in "fb"}

    def _direction(self, d: str, x: np.ndarray, skip: int, logits: np.ndarray, late: np.ndarray | None = None) -> None:
        """Adds one direction's part to logits; x (skip + L, B), in its order. late: how many columns have not begun at each step."""
        H, B = self.hidden, x.shape[1]
        W, U, c, O = self.table[d], self.cross[d], self.shift[d], self.out[d]
        h = np.zeros((H, B), np.float32)
        a, g, n = np.empty((3 * H, B), np.float32), np.empty((3 * H, B), np.float32), np.empty((H, B), np.float32)
        zr, part = np.empty((2 * H, B), np.float32), np.empty(logits.shape[1:], np.float32)
        steps = range(len(logits)) if d == "f" else range(len(logits) - 1, -1, -1)
        for t in range(len(x)):
            np.matmul(U, h, out=a)
            np.take(W, x[t], axis=1, out=g, mode="clip")
            np.add(g[: 2 * H], a[: 2 * H], out=zr)
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            np.add(a[2 * H :], c, out=n)
            n *= zr[H:]
            n += g[2 * H :]
            np.tanh(n, out=n)
            h -= n
            h *= zr[:H]
            h += n
            if late is not None and t < len(late):
                h[:, : late[t]] = 0
            if t >= skip:
                np.matmul(O, h, out=part)
                logits[steps[t - skip]] += part

    def familiar(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each row has letters and reads like the training texts."""
        mean, n = familiarity(self.known, data, offsets)
        return (n > 0) & (mean >= self.floor - SHORT / np.sqrt(np.maximum(n, 1)))

    def label(self, data: np.ndarray, offsets: np.ndarray, width: int = 2048, only_means: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(label of each byte, mean probabilities of each row). only_means: the labels, which cost time of their own, stay 0."""
        K, rows = len(self.names), len(offsets) - 1
        width = max(16, width * 8 // max(8, K))  # probabilities of a step stay of one size
        labels, pooled = np.zeros(len(data), np.int32), np.zeros((rows, K))
        sizes = np.diff(offsets)
        count = -(-sizes // SEGMENT)
        row = np.repeat(np.arange(rows), count)
        start = offsets[row] + SEGMENT * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
        end = np.minimum(start + SEGMENT, offsets[row + 1])
        order = np.argsort(end - start, kind="stable")
        for i in range(0, len(order), width):
            at = order[i : i + width]
            s, e = start[at], end[at]
            L = int((e - s).max())
            pos = s[:, None] + np.arange(-CONTEXT, L)
            lo, hi = offsets[row[at]][:, None], offsets[row[at] + 1][:, None]
            # before a text's beginning and after its end: line ends
            x = np.where((pos >= lo) & (pos < hi), data[np.clip(pos, 0, len(data) - 1)], 10)
            back = s[:, None] + np.arange(L + CONTEXT - 1, -1, -1)
            xb = np.where((back >= lo) & (back < hi), data[np.clip(back, 0, len(data) - 1)], 10)
            logits = np.empty((L, K, len(at)), np.float32)
            logits[:] = self.bias
            self._direction("f", np.ascontiguousarray(x.T), CONTEXT, logits)
            # columns are in order of length: backward, the shorter ones begin later
            self._direction("b", np.ascontiguousarray(xb.T), CONTEXT, logits, np.searchsorted(e - s, L - np.arange(L)))
            best = None if only_means else logits.argmax(1)
            logits -= logits.max(1, keepdims=True)
            np.exp(logits, out=logits)
            logits /= logits.sum(1, keepdims=True)
            inside = np.arange(L)[:, None] < (e - s)[None, :]
            sums = np.einsum("lkb,lb->bk", logits, inside.astype(np.float32))
            for k in range(K):
                pooled[:, k] += np.bincount(row[at], sums[:, k], minlength=rows)
            if best is not None:
                labels[pos[:, CONTEXT:][inside.T]] = best.T[inside.T]
        return labels, pooled / np.maximum(sizes, 1)[:, None]


def spans_of(labels: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, end, label) of the runs of equal labels, in characters of the row."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # a character has its first byte's label
    lab = labels[lead]
    row = np.searchsorted(offsets, lead, side="right") - 1
    cut = np.ones(len(lead), dtype=bool)
    cut[1:] = (lab[1:] != lab[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(cut)
    until = np.append(at[1:], len(lead))
    first = np.searchsorted(lead, offsets[row[at]]) if len(at) else at
    return row[at], at - first, until - first, lab[at]


def _result(network: Network | None, texts: pa.Array, min_confidence: float) -> pa.Array:
    n = len(texts)
    data, offsets = buffers(texts)
    empty = np.diff(offsets) == 0
    if network is None:
        none = pa.nulls(n, pa.string())
        zero = np.zeros(n, np.int64)
        return pa.StructArray.from_arrays(
            [none, pa.array(np.zeros(n)), pa.array(~empty), lists(pa.array([], pa.float32()), zero), lists(pa.nulls(0, ARROW.field("spans").type.value_type), zero)],
            fields=list(ARROW),
        )
    names, K = pa.array(network.names, pa.string()), len(network.names)
    probs, runs, familiar = [], [], []
    for i, j in slices(offsets, 1 << 19):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        labels, pooled = network.label(part, own)
        probs.append(pooled)
        familiar.append(network.familiar(part, own))
        row, start, end, lab = spans_of(labels, part, own)
        runs.append((row + i, start, end, lab))
    prob = np.concatenate(probs) if probs else np.zeros((0, K))
    row, start, end, lab = (np.concatenate(x) for x in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 4
    best = prob.argmax(1)
    confidence = np.where(empty, 0.0, prob[np.arange(n), best])
    spans = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), names.take(pa.array(lab.astype(np.int32)))], fields=list(ARROW.field("spans").type.value_type))
    return pa.StructArray.from_arrays(
        [
            names.take(pa.array(best.astype(np.int32), mask=empty)),
            pa.array(confidence),
            pa.array((confidence >= min_confidence) & (np.concatenate(familiar) if familiar else False) & ~empty),
            lists(pa.array(prob.ravel().astype(np.float32)), np.full(n, K)),
            lists(spans, np.bincount(row, minlength=n)),
        ],
        fields=list(ARROW),
    )


def _kept(network: Network | None, texts: pa.Array, min_confidence: float) -> pa.Array:
    """The field accepted of _result()."""
    data, offsets = buffers(texts)
    keep = np.diff(offsets) > 0
    if network is not None:
        for i, j in slices(offsets, 1 << 19):
            part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            _, pooled = network.label(part, own, only_means=True)
            keep[i:j] &= (pooled.max(1) >= min_confidence) & network.familiar(part, own)
    return pa.array(keep)


def sample(docs: DataFrame, text: str, label: str, most: int, chars: int, seed: int) -> tuple[list[str], list[str]]:
    """A bounded sample of pieces of labelled rows, the same for the same table: the least seeded hashes of each label in turn.

    A first cut at a share of each label's pieces (four times what is wanted) bounds what is put in order."""
    t, y = docs[text], docs[label].cast("string")
    rows = docs.select(t.alias("t"), y.alias("y"), F.xxhash64(t).alias("h"), F.ceil(F.length(t) / chars).alias("n")).filter("t is not null and y is not null and n > 0")
    size = rows.groupBy("y").agg((F.sum("n") * F.approx_count_distinct("h") / F.count("*")).alias("pieces"))
    cut = (F.least(F.lit(1.0), 4 * most / F.greatest(F.col("pieces"), F.lit(1.0))) * (1 << 20)).cast("int") + 1
    picked = F.filter(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.pmod(F.xxhash64(F.col("h"), i, F.lit(seed)), F.lit(1 << 20)) < F.col("cut"))
    some = rows.join(small(written(size.select("y", cut.alias("cut"))), 64, BROADCAST_BYTES), "y").select("y", "t", picked.alias("at")).filter(F.size("at") > 0)
    pieces = some.select("y", F.explode(F.transform("at", lambda i: F.col("t").substr((i * chars + 1).cast("int"), F.lit(chars)))).alias("t")).select("y", "t", F.xxhash64("t", F.lit(seed + 1)).alias("k"))
    turn = F.row_number().over(Window.partitionBy("y").orderBy("k"))
    got = pieces.dropDuplicates(["y", "k"]).withColumn("turn", turn).orderBy("turn", "k", "y").limit(most).collect()
    return [r["t"] for r in got], [r["y"] for r in got]


def fit(docs: DataFrame, *, text: str = "text", label: str = "lang", sample_pieces: int = 2000, piece_chars: int = 600, seed: int = 7, **options) -> dict | None:
    """A model trained on at most ``sample_pieces`` pieces of docs; ``label`` names the declared language."""
    return train(*sample(docs, text, label, sample_pieces, piece_chars, seed), seed=seed, **options)


def detector(model: dict | None, min_confidence: float = 0.4):
    """An Arrow UDF from a text to a struct of SCHEMA. accepted: the confidence reaches min_confidence and the text reads like those of the training."""

    @F.arrow_udf(SCHEMA)
    def detect(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        network = Network(model) if model is not None else None
        for texts in batches:
            yield _result(network, texts, min_confidence)

    return detect


def detect_languages(docs: DataFrame, model: dict | None, *, key: str = "doc_id", text: str = "text", min_confidence: float = 0.4) -> DataFrame:
    """(key, language, confidence, accepted, probabilities, spans) of every row; probabilities in the order of model["names"]."""
    found = docs.select(docs[key].alias("k"), detector(model, min_confidence)(docs[text]).alias("r"))
    return found.select(F.col("k").alias(key), "r.*")


def accepted(docs: DataFrame, model: dict | None, *, text: str = "text", min_confidence: float = 0.4) -> DataFrame:
    """The rows whose text the network accepts, with all their columns."""

    @F.arrow_udf("boolean")
    def keep(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        network = Network(model) if model is not None else None
        for texts in batches:
            yield _kept(network, texts, min_confidence)

    return docs.filter(keep(docs[text]))
