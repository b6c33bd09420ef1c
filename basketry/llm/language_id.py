"""Language ID by Bayesian evidence fusion.

For every row the posterior over languages combines

* the text: letter-trigram likelihoods (naive Bayes, tempered because trigrams
  overlap), fitted on a bounded sample of labelled documents;
* the declared markup language and the address suffix: P(value | language),
* the host: P(language | host) smoothed towards its domain, and that towards
  the whole table (Dirichlet weights ``ALPHA``).

The last three come from grouped sums of the rows' text posteriors over the
whole table, less the row's own share (so that no row is evidence for itself).
Rows are grouped once, by (host, suffix, declared); the rest of the statistics
are sums over those groups.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import saved, slices, utf8

SAMPLE_ROWS = 400      # labelled rows fitted on, per language (expected number)
LANGUAGES = 256        # labels that are languages, at most (1 MB of table each)
EQUAL, UNSEEN = 1e5, 0.02  # trigrams that a language counts as, and those of one never seen
OTHER = 0.05           # prior of no language
TEMPER = 0.3
ALPHA = 5.0
LEAST = 0.5            # posterior below which a row is rejected

# Letter classes: 0 anything that is no letter, 1-26 a-z, 27-63 bytes of other letters.
_CODE = np.zeros(256, np.int32)
for _b in range(26):
    _CODE[97 + _b] = _CODE[65 + _b] = _b + 1
_CODE[128:] = 27 + np.arange(128) % 37
_LETTER_TRIGRAMS = 64.0 ** 3


def _trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram number at every byte (0: none), and the letters up to it."""
    c = _CODE[data]
    t = np.zeros(len(c), np.int32)
    if len(c) > 2:
        t[:-2] = (c[:-2] << 12) | (c[1:-1] << 6) | c[2:]
        blank = (c[:-2] == 0).astype(np.int8) + (c[1:-1] == 0) + (c[2:] == 0)
        t[:-2][blank > 1] = 0
        ends = offs[1:][np.diff(offs) > 0]
        t[ends - 1] = 0
        t[np.maximum(ends - 2, 0)] = 0
    return t, np.concatenate([[0], np.cumsum(c > 0)])


def _counts(batches):
    """Sums of the trigrams of whole texts, by label: (l, t, c)."""
    sums: dict[str, np.ndarray] = {}
    for part in slices(batches):
        data, offs = utf8(part.column(0))
        t, _ = _trigrams(data, offs)
        for i, label in enumerate(part.column(1).to_pylist()):
            if label not in sums:
                sums[label] = np.zeros(1 << 18, np.int64)
            np.add.at(sums[label], t[offs[i]:offs[i + 1]], 1)
    for label, c in sums.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at), pa.array(c[at])], ["l", "t", "c"])


def fit(docs: DataFrame, label: str = "lang", text: str = "text", doc_id: str = "doc_id",
        rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their table of trigram log likelihoods, fitted on about
    ``rows`` whole texts of each label, chosen by a hash of the id. The last row
    of the table is no language: every trigram is equally likely there, so text
    in a language or script without labels, or noise, finds more of its trigrams
    there than in any language. Languages count alike however much text each has;
    at most ``LANGUAGES`` labels, the most frequent, are languages."""
    d = docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{label}`").alias("l"),
                    F.pmod(F.xxhash64(F.col(f"`{doc_id}`")), F.lit(1_000_000)).alias("h"))
    d = d.where("l is not null and t is not null")
    counts = {r["l"]: r["count"] for r in d.groupBy("l").count().orderBy(F.col("count").desc(), "l").limit(LANGUAGES).collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((0, 1 << 18), np.float32)
    pick = F.lit(False)
    for name in langs:
        pick = pick | ((F.col("l") == name) & (F.col("h") < int(1e6 * min(1.0, rows / counts[name])) + 1))
    found = d.where(pick).select("t", "l").mapInArrow(_counts, "l string, t long, c long").groupBy("l", "t").agg(F.sum("c").alias("c"))
    seen = np.zeros((len(langs), 1 << 18))
    for r in found.toArrow().to_batches():  # at most languages x trigrams, whatever the rows
        which = np.array([langs.index(x) for x in r.column(0).to_pylist()], np.int64)
        seen[which, r.column(1).to_numpy()] = r.column(2).to_numpy()
    seen[:, 0] = 0
    size = seen.sum(1, keepdims=True)
    share = (seen * (EQUAL / np.maximum(size, 1)) + UNSEEN) / (EQUAL * (size > 0) + UNSEEN * seen.shape[1])
    table = np.log(np.vstack([share, np.full(seen.shape[1], 1 / _LETTER_TRIGRAMS)]))
    table -= table[:-1].mean(0)
    table[:, 0] = 0
    return langs, table.astype(np.float32)


_STRIP = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;")


def _likelihoods(table: np.ndarray, markup: bool):
    def run(batches):
        for part in slices(batches):
            data, offs = utf8(part.column(0))
            if markup:
                raw = data.tobytes()
                texts = [_STRIP.sub(b" ", raw[a:z]) for a, z in zip(offs[:-1].tolist(), offs[1:].tolist())]
                data = np.frombuffer(b"".join(texts), np.uint8)
                offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            t, letters = _trigrams(data, offs)
            ll = np.zeros((len(offs) - 1, len(table)))
            for i, row in enumerate(table):
                total = np.concatenate([[0.0], np.cumsum(row[t], dtype=np.float64)])
                ll[:, i] = total[offs[1:]] - total[offs[:-1]]
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, ll.size + 1, max(1, len(table)), dtype=np.int32)[:len(ll) + 1]), pa.array(ll.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array(letters[offs[1:]] - letters[offs[:-1]]), lists],
                [*part.schema.names[1:], "letters", "ll"])
    return run


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _rows(col: pa.Array, n: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _text_posterior(letters: np.ndarray, ll: np.ndarray) -> np.ndarray:
    """Of the languages, beside that of no language (last in ``ll``); uniform for
    rows without a letter."""
    n = ll.shape[1] - 1
    scores = ll * TEMPER
    scores[:, -1] += np.log(OTHER * n)
    return np.where(letters[:, None] > 0, _softmax(scores)[:, :-1], 1.0 / n)


def _fuse(langs: list[str], every: np.ndarray, carry: int):
    """Rows (carried columns, suffix and declared present, letters, ll, sums of
    text posteriors over the row's host, domain, suffix and declared value)."""
    n = len(langs)
    names = pa.array(langs, pa.string())

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            col = b.columns[carry:]
            present = {k: c.to_numpy(zero_copy_only=False).astype(bool)[:, None] for k, c in zip("sm", col[:2])}
            letters, ll = col[2].to_numpy(), _rows(col[3], n + 1)
            own = _text_posterior(letters, ll)
            left = {k: np.maximum(_rows(c, n) - own, 0.0) for k, c in zip("hdsm", col[4:])}
            all_rows = np.maximum(every - own, 0.0)
            prior = (all_rows + 1.0) / (all_rows.sum(1, keepdims=True) + n)
            for k in "dh":
                prior = (left[k] + ALPHA * prior) / (left[k].sum(1, keepdims=True) + ALPHA)
            known = letters > 0
            score = np.where(known[:, None], ll[:, :-1] * TEMPER, 0.0) + np.log(prior)
            none = np.where(known, ll[:, -1] * TEMPER, -np.inf) + np.log(OTHER)
            for k in "sm":
                score += np.where(present[k], np.log((left[k] + 0.5) / (all_rows + 5.0)), 0.0)
                # without a language a value is as likely as it is over all rows
                whole = np.log((left[k].sum(1) + 0.5) / (all_rows.sum(1) + 5.0))
                none += np.where(present[k][:, 0], whole, 0.0)
            post = _softmax(np.column_stack([score, none]))[:, :-1]
            text_best = pa.array(ll[:, :-1].argmax(1), mask=~known)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:carry], names.take(pa.array(post.argmax(1))), pa.array(post.max(1)),
                 names.take(text_best), pa.array(known & (post.max(1) >= LEAST))],
                [*b.schema.names[:carry], *ADDED])
    return run


ADDED = ("language", "confidence", "text_language", "accepted")


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], markup: bool = False) -> DataFrame:
    """``rows``: ``text, host, domain, suffix, declared`` (strings, null: no
    evidence) and any columns to carry. Adds ``language`` (null if none),
    ``confidence``, ``text_language``, ``accepted``; drops ``text``. A carried
    column that is named like an added one gives way to it; all other names are
    free.

    A row without a letter, or with a posterior below ``LEAST`` (no language is a
    hypothesis, too), is not accepted. Null and empty texts have no letters.
    Equal posteriors: the language that comes first by name. Repeated rows count
    each. Texts are read whole. Without any labelled row there are no languages
    and nothing is accepted.
    """
    langs, table = model
    names = [c for c in rows.columns if c != "text" and c not in ADDED]
    if not langs:
        return rows.select(*[F.col(f"`{c}`") for c in names], F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"),
                           F.lit(None).cast("string").alias("text_language"), F.lit(False).alias("accepted"))
    carry = [f"__c{i}" for i in range(len(names))]  # no name of a row's own can clash
    r = rows.select(F.coalesce("text", F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(k) for c, k in zip(names, carry)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in r.schema.fields[1:])
    scored = r.mapInArrow(_likelihoods(table, markup), f"{schema}, letters long, ll array<double>")
    keys = ["host", "domain", "suffix", "declared"]
    scored = saved(scored.withColumns({f"__{k}": F.coalesce(F.col(carry[names.index(k)]), F.lit("")) for k in keys}), "likelihoods")
    keys = [f"__{k}" for k in keys]
    n = range(len(langs))
    # The text posterior of a row, as in _text_posterior.
    top = F.array_max("ll")
    e = F.transform("ll", lambda v, i: F.exp((v - top) * TEMPER) * F.when(i == len(langs), OTHER * len(langs)).otherwise(1.0))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    p = F.when(F.col("letters") > 0, F.transform(e, lambda v: v / total)).otherwise(
        F.array_repeat(F.lit(1.0 / len(langs)), len(langs)))
    groups = scored.select(*keys, p.alias("p")).groupBy(*keys).agg(*[F.sum(F.col("p")[i]).alias(f"p{i}") for i in n])
    groups = saved(groups, "evidence")

    def over(key, name):
        return groups.groupBy(key).agg(F.array(*[F.sum(f"p{i}") for i in n]).alias(name))
    whole = groups.agg(*[F.sum(f"p{i}").alias(f"a{i}") for i in n]).head()
    every = np.array([float(whole[f"a{i}"] or 0.0) for i in n])
    stat = groups.select(*keys)
    for k, name in zip(keys, "hdsm"):
        stat = stat.join(over(k, f"__{name}"), k)
    x = scored.join(saved(stat, "statistics"), keys).select(
        *carry, (F.col("__suffix") != "").alias("has_s"), (F.col("__declared") != "").alias("has_m"), "letters", "ll",
        "__h", "__d", "__s", "__m")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields[:len(carry)])
    out = x.mapInArrow(_fuse(langs, every, len(carry)), f"{schema}, language string, confidence double, "
                       "text_language string, accepted boolean")
    return out.select(*[F.col(k).alias(c) for c, k in zip(names, carry)], *ADDED)


def page_evidence(pages: DataFrame) -> DataFrame:
    """Text, host, domain, suffix and declared language of web pages."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    lang = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return pages.select(F.col("html").alias("text"), "page_id", "url", host.alias("host"),
                        F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1).alias("domain"),
                        F.regexp_extract(host, r"\.([^.]*)$", 1).alias("suffix"), lang.alias("declared"))


def accepted_documents(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (columns unchanged) whose language is identified. The
    source stands for the host, ``lang`` for the declared language; both may be
    null. The rejected rows, found by id and text hash, are taken away by an
    anti join; repeated rows share their fate."""
    model = fit(docs)
    none = F.lit(None).cast("string")
    rows = docs.select("text", "doc_id", F.col("source").alias("host"), none.alias("domain"), none.alias("suffix"),
                       F.col("lang").alias("declared"), F.xxhash64("text").alias("mark"))
    gone = identify(rows, model).where("not accepted").select(
        F.coalesce("doc_id", F.lit(-1)).alias("k1"), F.col("doc_id").isNull().alias("k2"), F.col("mark").alias("k3"))
    gone = saved(gone.distinct(), "rejected")
    on = ((F.coalesce(docs["doc_id"], F.lit(-1)) == gone["k1"]) & (docs["doc_id"].isNull() == gone["k2"])
          & (F.xxhash64(docs["text"]) == gone["k3"]))
    return docs.join(gone, on, "left_anti")
