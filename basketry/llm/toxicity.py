"""Toxicity by compression distance.

Two zstandard dictionaries of equal length are trained, one on toxic and one
on ordinary text. Each word of a text is a window, compressed with both; the
share of the bytes that the toxic dictionary saves is its evidence. The largest
shares of a document and the numbers of large ones go through a logistic curve
fitted on other labelled rows than the dictionaries, so that scores are
probabilities.

Training segments for the toxic dictionary are the words that begin as words
of significantly more toxic documents than ordinary ones do. The ordinary
dictionary holds, at the same offsets, the same words with those beginnings
replaced by ordinary ones: outside them both dictionaries compress a window
alike, so common syllables cancel out. Windows are encoded as UTF-16: a
literal then costs twice as much and a match still costs the same, which lets
words of four letters tell.

Labels come from rows whose crc32(doc_id) mod 4 is not 2, at most ``TOXIC``
toxic and ``ORDINARY`` other rows for either fit. Training and scoring read
every text as a whole; the dictionaries learn from its distinct windows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import slices, utf8

TOXIC, ORDINARY = 1500, 2500
LEAST = 0.3     # score from which a document is predicted toxic
# A beginning tells if toxic documents hold it this many times as often, and the
# log likelihood ratio against chance is at least this.
LIFT, EVIDENCE = 8, 10
HITS = (0.25, 0.3, 0.35, 0.4, 0.45)  # shares saved from which windows are counted
CACHE = 300_000
_WORD = re.compile(rb"[a-z\x80-\xff]{4,64}")
_RUN = re.compile(rb"[^\x09-\x0d\x20]{1,64}")
_AROUND = b".,;:!?\"'()[]|"
FEATURES = ["top", "second", "five", "words", *[f"hits{i}" for i in range(len(HITS))]]


def words_of(text: bytes) -> list[bytes]:
    """Windows of a text: its words, and every run between blanks that isn't one
    word (short ones, and those with digits or signs inside), in parts of 64
    bytes. Only punctuation around a run is left away."""
    text = text.lower()
    out = _WORD.findall(text)
    for run in _RUN.findall(text):
        inner = run.strip(_AROUND) or run
        if not _WORD.fullmatch(inner):
            out.append(inner)
    return out


def vocabulary(text: bytes) -> list[bytes]:
    """Distinct windows of a text, by first place."""
    return list(dict.fromkeys(words_of(text)))


def _weighted(docs: list[list[bytes]]) -> list[tuple[list[bytes], float]]:
    """Vocabularies with the share of them that is new: of a text's triples (of
    shorter ones: the whole), those that no earlier text holds. Copies repeat
    evidence without adding any; no text is left out."""
    seen: set = set()
    out = []
    for w in docs:
        g = set(zip(w, w[1:], w[2:])) or {tuple(w)}
        out.append((w, len(g - seen) / len(g)))
        seen |= g
    return out


def _beginnings(docs: list[tuple[list[bytes], float]]) -> Counter:
    """Weight of the texts that hold each beginning."""
    f: Counter = Counter()
    for words, weight in docs:
        if weight > 0:
            for p in {w[:k] for w in words for k in range(4, len(w) + 1)} | {w + b" " for w in words if len(w) < 4}:
                f[p] += weight
    return f


def train_dictionaries(toxic: list, ordinary: list) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary, from texts or their
    vocabularies."""
    tox, other = (_weighted([vocabulary(t) if isinstance(t, bytes) else t for t in side]) for side in (toxic, ordinary))
    ft, fo = _beginnings(tox), _beginnings(other)
    n_tox, n_other = (max(sum(x for _, x in side), 1e-9) for side in (tox, other))
    share = n_tox / (n_tox + n_other)
    telling: list[bytes] = []
    for p in sorted((p for p, n in ft.items() if n > 3), key=lambda p: (len(p), p)):
        n, m = ft[p], fo.get(p, 0)
        lift = (n / n_tox) / ((m + 0.5) / (n_other + 1))
        if lift > LIFT and not p.startswith(tuple(telling)):
            if n * np.log(n / (share * (n + m))) + (m and m * np.log(m / ((1 - share) * (n + m)))) > EVIDENCE:
                telling.append(p)
    starts = tuple(telling)
    words = Counter(w for d, _ in tox for w in d if starts and (w + b" ").startswith(starts))
    common = [w for w, _ in Counter(w for d, _ in other for w in d).most_common(1500)] or [b"...."]
    a, b, k = [], [], 0
    for w in sorted(words, key=lambda w: (words[w], w)):
        n = min(len(w), max(len(p) for p in telling if (w + b" ").startswith(p)))
        fill = b""
        while len(fill) < n:
            fill += common[k % len(common)][:n - len(fill)]
            k += 1
        a.append(_window(w, len(w)))
        b.append(_window(fill + w[n:], len(w)))
    return b"".join(a), b"".join(b)


def _window(word: bytes, length: int) -> bytes:
    """Wider yet for short words, of which a match would save nothing else."""
    return (b" " + word + b" ").decode("utf-8", "replace").encode("utf-16-le" if length > 3 else "utf-32-le")


class Savings:
    """Share of bytes saved per window; words seen lately are remembered."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.pair = [self._compressor(d) for d in (ordinary, toxic)]
        self.cache: dict[bytes, float] = {}

    @staticmethod
    def _compressor(data: bytes) -> zs.ZstdCompressor:
        d = zs.ZstdCompressionDict(data.ljust(16, b"\0"), dict_type=zs.DICT_TYPE_RAWCONTENT)
        p = zs.ZstdCompressionParameters.from_level(
            6, source_size=64, dict_size=len(data), min_match=5, strategy=zs.STRATEGY_BTLAZY2,
            write_checksum=False, write_content_size=False, write_dict_id=False)
        d.precompute_compress(compression_params=p)
        return zs.ZstdCompressor(dict_data=d, compression_params=p)

    def of(self, word: bytes) -> float:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            window = _window(word, len(word))
            o, t = (len(c.compress(window)) for c in self.pair)
            got = self.cache[word] = (o - t) / o
        return got

    def features(self, text: bytes) -> list[float]:
        words = words_of(text)
        if not words:
            return [0.0] * len(FEATURES)
        of = self.of
        large = sorted((x for x in map(of, words) if x > 0), reverse=True)
        top = large[:5] + [0.0] * max(0, min(5, len(words)) - len(large))
        hits = np.searchsorted(-np.array(large), -np.array(HITS), side="right")
        return [top[0], top[1] if len(top) > 1 else 0.0, sum(top) / len(top), float(np.log1p(len(words))), *np.log1p(hits).tolist()]


def _features(toxic: bytes, ordinary: bytes):
    def run(batches):
        savings = Savings(toxic, ordinary)
        for part in slices(batches):
            data, offs = utf8(part.column(0))
            raw, o = data.tobytes(), offs.tolist()
            x = np.array([savings.features(raw[a:z]) for a, z in zip(o, o[1:])]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], *[pa.array(c) for c in np.ascontiguousarray(x.T)]], [*part.schema.names[1:], *FEATURES])
    return run


def _vocabularies(batches):
    for part in slices(batches):
        data, offs = utf8(part.column(0))
        raw, o = data.tobytes(), offs.tolist()
        words = pa.array([vocabulary(raw[a:z]) for a, z in zip(o, o[1:])], pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([*part.columns[1:], words], [*part.schema.names[1:], "words"])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton steps of a weighted logistic regression (intercept first)."""
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    b = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.eye(len(b))
        b += np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge * len(x) * b)
    slope = b[1:] / sd
    return np.concatenate([[b[0] - (slope * mean).sum()], slope])


def held_out(doc_id):
    """Column: rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    ``labels`` has ``doc_id, toxic``; null labels are ignored, an id labelled
    twice counts as toxic if either label is. Null and empty texts have no
    windows and get the score of a text without evidence. Without labels of
    both classes every score is the share of toxic ones (0 without labels). A
    null id is never held out. Repeated rows get the same score. Other columns of
    either table, whatever their names, play no part.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")).withColumn("for_dict", F.crc32(F.col("doc_id").cast("string")) % 4 != 3)
    counts = {(r["toxic"] == 1, r["for_dict"]): r["n"] for r in
              known.groupBy((F.col("toxic") == 1).cast("int").alias("toxic"), "for_dict").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = []
    for (tox, for_dict), n in counts.items():
        rows = known.where((F.col("toxic") == 1) == tox).where(F.col("for_dict") == for_dict)
        rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").limit(TOXIC if tox else ORDINARY).collect()
        picked += [(r["doc_id"], tox, for_dict, n / len(rows)) for r in rows]
    n_tox = sum(n for (tox, _), n in counts.items() if tox)
    share = n_tox / max(1, sum(counts.values()))
    flat = texts.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(share).alias("score"),
                        F.lit(int(share >= LEAST)).alias("predicted"))
    if not 0 < share < 1:
        return flat
    # At most 2 * (TOXIC + ORDINARY) rows of four small columns.
    sample = F.broadcast(spark.createDataFrame(picked, "doc_id long, tox boolean, for_dict boolean, weight double"))
    drawn = texts.join(sample, "doc_id").select("text", "doc_id", "tox", "for_dict", "weight")
    for_dict = drawn.where("for_dict").select("text", "doc_id", "tox").mapInArrow(
        _vocabularies, "doc_id long, tox boolean, words array<binary>").toArrow().to_pylist()
    for_dict.sort(key=lambda r: (r["doc_id"], r["words"]))
    both = [[r["words"] for r in for_dict if r["tox"] == side] for side in (True, False)]
    pair = train_dictionaries(*both)
    names = ", ".join(f"{f} double" for f in FEATURES)
    fit = drawn.where("not for_dict").select("text", "doc_id", "tox", "weight").mapInArrow(
        _features(*pair), f"doc_id long, tox boolean, weight double, {names}").toPandas().sort_values(["doc_id", *FEATURES])
    if fit["tox"].nunique() < 2:
        return flat
    b = _logistic(fit[FEATURES].to_numpy(), fit["tox"].to_numpy(float), fit["weight"].to_numpy())
    x = texts.mapInArrow(_features(*pair), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {names}")
    logit = F.lit(float(b[0]))
    for f, v in zip(FEATURES, b[1:]):
        logit = logit + F.col(f) * float(v)
    score = 1 / (1 + F.exp(-logit))
    return x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"),
                    (score >= LEAST).cast("int").alias("predicted"))
