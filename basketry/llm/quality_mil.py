"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words each (the whole text, the
last passage may be shorter). A passage is described by what its bytes and words
look like: shares of letters, digits and every ASCII sign, of neighbouring kinds,
lengths, and how many of its words and word pairs the document has had before.
An encoder turns that into a vector h; gated attention
``softmax(w . (tanh(V h) * sigmoid(U h)))`` over the bag weighs the passages, and
the weighted vector gives the score. All parameters are learned together, by
gradient steps, from document labels alone; a fifth of the rows stops the steps
and calibrates the probability.

At most ``SAMPLE`` labelled rows of either class are learned from (the first by
hash of the id, weighted back to their class); every row is scored.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import slices, utf8

SAMPLE = 2000   # labelled rows of either class that the model learns from
PASSAGE = 40    # words of a passage
LEAST = 0.3     # score from which a document is predicted good
HIDDEN, GATE = 24, 12
STEPS, PATIENCE, RATE, DECAY = 600, 80, 0.01, 1e-3

_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
# Kinds of bytes: 0 blank, 1 line end, 2 lower, 3 upper, 4 digit, 5 first byte of
# another character, 6 further bytes, 7 other controls, then each ASCII sign.
_KIND = np.full(256, 7)
_KIND[[9, 11, 12, 32]], _KIND[[10, 13]] = 0, 1
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[192:], _KIND[128:192] = 2, 3, 4, 5, 6
_KIND[_SIGNS] = 8 + np.arange(len(_SIGNS))
KINDS = 8 + len(_SIGNS)
_COARSE = np.minimum(_KIND, 8)
WIDTH = KINDS + 81 + 5


def passages(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Descriptions of all passages of some texts, and the passages' offsets by
    text. A text without words is one passage."""
    n_docs = len(offs) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(offs))
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    start = ~blank
    start[1:] &= blank[:-1] | (doc[1:] != doc[:-1])
    at = np.flatnonzero(start)
    per_doc = np.bincount(doc[at], minlength=n_docs)
    first_word = np.cumsum(per_doc) - per_doc
    bags = np.concatenate([[0], np.cumsum(np.maximum(1, -(-per_doc // PASSAGE)))])
    word_doc = doc[at]
    word_bag = bags[word_doc] + (np.arange(len(at)) - first_word[word_doc]) // PASSAGE
    # blanks before the first word belong to the first passage
    seen = np.cumsum(start) - 1 - first_word[doc]
    byte_bag = bags[doc] + np.maximum(seen, 0) // PASSAGE
    n = int(bags[-1])
    kind, coarse = _KIND[data], _COARSE[data]
    size = np.maximum(np.bincount(byte_bag, minlength=n), 1)[:, None]
    kinds = np.bincount(byte_bag * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS) / size
    near = byte_bag[1:] == byte_bag[:-1]
    pairs = np.bincount(byte_bag[1:][near] * 81 + coarse[:-1][near] * 9 + coarse[1:][near], minlength=n * 81).reshape(n, 81) / size
    n_words = np.bincount(word_bag, minlength=n)
    words = np.maximum(n_words, 1)
    more = np.zeros((n, 5))
    if len(at):
        # 64-bit hashes of words: sums of byte times a power by place in the word
        place = np.arange(len(data)) - at[np.maximum(np.cumsum(start) - 1, 0)]
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(place[~blank].max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
            term = np.where(blank, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * power[np.where(blank, 0, place)])
            hashes = np.add.reduceat(term, at)
            two = hashes[:-1] * np.uint64(31) + hashes[1:]
        letters = np.bincount(word_bag, np.add.reduceat((~blank).astype(float), at), n)
        pair_doc, joined = word_doc[1:], word_doc[1:] == word_doc[:-1]
        more[:, 0] = np.log1p(n_words)
        more[:, 1] = np.log1p(letters / words)
        more[:, 2] = _fresh(word_bag, hashes, word_bag, n) / words
        more[:, 3] = _fresh(word_doc, hashes, word_bag, n) / words
        more[:, 4] = _fresh(pair_doc[joined], two[joined], word_bag[1:][joined], n) / words
    x = np.concatenate([np.sqrt(kinds), np.sqrt(pairs), more], axis=1)
    return x.astype(np.float32), bags


def _fresh(group: np.ndarray, key: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
    """By bag, how many keys occur for the first time in their group."""
    o = np.lexsort((np.arange(len(key)), key, group))
    g, k = group[o], key[o]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])[:len(o)]
    return np.bincount(bag[o[new]], minlength=n)


def _softmax(s: np.ndarray, bags: np.ndarray) -> np.ndarray:
    at, n = bags[:-1], np.diff(bags)
    e = np.exp(s - np.repeat(np.maximum.reduceat(s, at), n))
    return e / np.repeat(np.add.reduceat(e, at), n)


class Attention:
    """Encoder, gated attention and output; ``p`` holds the parameters."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @classmethod
    def begin(cls, width: int, rnd: np.random.Generator) -> Attention:
        def w(a, b):
            return rnd.normal(0, 1 / np.sqrt(a), (a, b)).astype(np.float32)
        return cls({"E": w(width, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": w(HIDDEN, GATE), "U": w(HIDDEN, GATE),
                    "w": w(GATE, 1)[:, 0], "o": w(HIDDEN, 1)[:, 0], "b": np.zeros(1, np.float32)})

    def forward(self, x: np.ndarray, bags: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = _softmax((t * s) @ p["w"], bags)
        z = np.add.reduceat(a[:, None] * h, bags[:-1])
        return z @ p["o"] + p["b"][0], (h, t, s, a, z)

    def gradient(self, x, bags, y, weight):
        """Of the weighted mean log loss."""
        p = self.p
        logit, (h, t, s, a, z) = self.forward(x, bags)
        prob = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        d = weight * (prob - y) / weight.sum()
        row = np.repeat(np.arange(len(d)), np.diff(bags))
        dz = d[:, None] * p["o"]
        da = (dz[row] * h).sum(1)
        dscore = a * (da - np.add.reduceat(a * da, bags[:-1])[row])
        g = dscore[:, None] * p["w"]
        dv, du = g * s * (1 - t * t), g * t * s * (1 - s)
        dh = (a[:, None] * dz[row] + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (t * s).T @ dscore,
                "o": z.T @ d, "b": np.array([d.sum()])}


def _loss(logit, y, weight) -> float:
    return float((weight * np.logaddexp(0, np.where(y > 0, -logit, logit))).sum() / weight.sum())


def _platt(logit, y, weight) -> tuple[float, float]:
    """Slope and shift of the calibrated logit, by Newton steps."""
    b = np.array([1.0, 0.0])
    x = np.column_stack([logit, np.ones(len(logit))])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-3 * weight.sum() * np.eye(2)
        b = b + np.linalg.solve(hess, x.T @ (weight * (y - q)) - 1e-3 * weight.sum() * (b - [1.0, 0.0]))
    return (float(b[0]), float(b[1])) if b[0] > 0 else (1.0, 0.0)


def train(docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters from descriptions of the passages of labelled documents: Adam on
    four fifths of them, the best step on the rest."""
    rnd = np.random.default_rng(seed)
    rest = np.arange(len(docs)) % 5 == 4
    if len(set(y[rest])) < 2 or len(set(y[~rest])) < 2:
        rest = np.zeros(len(docs), bool)

    def bags_of(rows):
        return np.concatenate([docs[k] for k in rows]), np.cumsum([0] + [len(docs[k]) for k in rows])

    fit = np.flatnonzero(~rest)
    held = np.flatnonzero(rest) if rest.any() else fit
    x, bags = bags_of(fit)
    mean, sd = x.mean(0, dtype=float).astype(np.float32), x.std(0, dtype=float).astype(np.float32) + np.float32(0.01)
    y, weight = y.astype(np.float32), (weight / weight.mean()).astype(np.float32)
    x = (x - mean) / sd
    hx, hbags = bags_of(held)
    hx = (hx - mean) / sd
    net = Attention.begin(x.shape[1], rnd)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(u) for k, u in net.p.items()}
    best, kept, since = np.inf, None, 0
    for step in range(1, STEPS + 1):
        g = net.gradient(x, bags, y[fit], weight[fit])
        for k in net.p:
            grad = g[k] + DECAY * net.p[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            net.p[k] = net.p[k] - RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        loss = _loss(net.forward(hx, hbags)[0], y[held], weight[held])
        since += 1
        if loss < best:
            best, kept, since = loss, dict(net.p), 0
        if since >= PATIENCE:
            break
    slope, shift = _platt(Attention(kept).forward(hx, hbags)[0], y[held], weight[held])
    return {**kept, "mean": mean, "sd": sd, "platt": np.array([slope, shift])}


def scores(p: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray) -> np.ndarray:
    """In double precision and rounded, so that no score depends on its batch."""
    logit = Attention({k: v.astype(float) for k, v in p.items()}).forward((x.astype(float) - p["mean"]) / p["sd"], bags)[0]
    return np.round(1 / (1 + np.exp(-np.clip(p["platt"][0] * logit + p["platt"][1], -500, 500))), 9)


def _described(batches):
    for part in slices(batches):
        x, bags = passages(*utf8(part.column(0)))
        rows = pa.array([x[a:z].tobytes() for a, z in zip(bags, bags[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([*part.columns[1:], rows], [*part.schema.names[1:], "passages"])


def _scored(p: dict[str, np.ndarray]):
    def run(batches):
        for part in slices(batches):
            x, bags = passages(*utf8(part.column(0)))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(scores(p, x, bags))], [*part.schema.names[1:], "score"])
    return run


def held_out(doc_id):
    """Column: rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    ``labels`` has ``doc_id, quality`` (0 or 1); null labels are ignored, an id
    labelled twice counts as good only if both labels are. Null and empty texts
    are one empty passage. Without labels of both classes every score is the
    share of good ones (0 without labels). A null id is never held out. Repeated
    rows get the same score; further columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = sum(n for q, n in counts.items() if q == 1) / max(1, sum(counts.values()))
    if not 0 < share < 1:
        return texts.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(float(share)).alias("score"),
                            F.lit(int(share >= LEAST)).alias("predicted"))
    picked = []
    for good in (True, False):
        rows = known.where((F.col("quality") == 1) == good).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()
        total = sum(n for q, n in counts.items() if (q == 1) == good)
        picked += [(r["doc_id"], good, total / len(rows)) for r in rows]
    # At most 2 * SAMPLE rows of three small columns.
    sample = F.broadcast(spark.createDataFrame(picked, "doc_id long, good boolean, weight double"))
    drawn = texts.join(sample, "doc_id").select("text", "doc_id", "good", "weight").mapInArrow(
        _described, "doc_id long, good boolean, weight double, passages binary")
    rows = sorted(drawn.collect(), key=lambda r: (crc32(str(r["doc_id"]).encode()), r["doc_id"], bytes(r["passages"])))
    described = [np.frombuffer(r["passages"], np.float32).reshape(-1, WIDTH) for r in rows]
    y = np.array([float(r["good"]) for r in rows])
    if len(set(y)) < 2:
        return texts.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(float(share)).alias("score"),
                            F.lit(int(share >= LEAST)).alias("predicted"))
    model = train(described, y, np.array([r["weight"] for r in rows]))
    kind = texts.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(_scored(model), f"doc_id {kind}, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= LEAST).cast("int").alias("predicted"))
