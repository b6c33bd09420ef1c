"""Review text mining with dictionaries.

The reference calls Java table functions with trained sentence/entity
models (not in its tree). Here a review is split into sentences and tokens
with built-in regex functions, and entries are whole tokens in a row: an entry
of n tokens occurs where n neighbouring tokens of the sentence are its own
("new york" not in "new yorkshire", "at&t" in "AT & T"). Where entries meet,
the scan from the left takes the longest at each place, none overlapping.

A bitmap of the entries' hashes (``dictionary.HashFilter``) is tested inside the
same generated code that splits the text, so only tokens that may be entries
become rows; they equi-join the entries. Nothing leaves the JVM.

Sentence = maximal run of characters other than . ! ? of the lower-cased
text; a token is a run of letters (Unicode ``\\p{L}``), a run of digits, or one
other sign. The regexes mean the same in Java and RE2, so SQL engines agree
on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.dictionary import HashFilter, entries, leftmost_longest, tokens
from basketry.sources.delimited import ctas_temp

SENTENCE_RE = "[^.!?]+"
WORD_RE = "\\p{L}+"

# Fixed test lexicon: words that occur in the generated review text (the
# text is invented, ordinary sentiment words do not occur in it).
DEFAULT_LEXICON = {
    "POS": ["rest", "best", "than"],
    "NEG": ["are", "was", "thon"],
}

# Words that turn the polarity of the words after them.
NEGATORS = ("no", "not", "never", "nicht", "kein", "pas", "jamais", "nunca", "sin")
SCOPE = 3  # tokens that a negator reaches
FEW = 16   # beginnings of entries that are looked for one by one
SMALL = 500_000  # words of a polarity lexicon (some 30 MB) that every executor may hold


def lexicon_df(spark: SparkSession, lexicon: dict | None = None) -> DataFrame:
    """(word, sentiment) rows from {sentiment: [words]}."""
    lex = lexicon or DEFAULT_LEXICON
    # SQL values make a local relation, whose size Catalyst knows.
    quoted = [(w.lower().replace("\\", "\\\\").replace("'", "\\'"), pol) for pol, words in lex.items() for w in words]
    values = ", ".join(f"('{w}', '{pol}')" for w, pol in quoted)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(word, sentiment)")


def sentences(df: DataFrame, text: str, keep: list[str], out: str = "review_sentence") -> DataFrame:
    """One row per sentence of the lower-cased ``text``; ``keep`` columns carried."""
    return df.select(*keep, F.explode(
        F.regexp_extract_all(F.lower(F.col(text)), F.lit(SENTENCE_RE), 0)).alias(out))


def _places(toks: str):
    """Tokens with their places. Not the bare column: from that Catalyst infers a
    filter on its size, which would cut the text into tokens a second time."""
    return F.posexplode(F.slice(toks, 1, 2 ** 31 - 1))


def occurrences(sents: DataFrame, sentence: str, keep: list[str], names: DataFrame, name: str,
                carry: list[str] | tuple = ()) -> DataFrame:
    """``keep``, ``sentence``, ``name`` and ``carry``: one row per row of ``sents`` and
    distinct entry of ``names`` in it.

    Entries of one token each need no more than the sentence's distinct tokens.
    Longer ones: places whose token begins an entry try all lengths up to the
    longest; the windows that pass the bitmap meet the entries, and per sentence
    the matches are chosen from the left. Only sentences with a match are
    shuffled for that.
    """
    e = entries(names, name, carry)
    toks = tokens(F.col(sentence))
    few = e.select(F.split_part("_tokens", F.lit(" "), F.lit(1)).alias("f"), "_n").distinct().limit(FEW + 1).collect()
    if len(few) <= FEW:
        # A sentence that holds an entry holds its first token: plain substring
        # tests refuse the others before they are cut into tokens.
        held = F.lit(False)
        for f in sorted({r["f"] for r in few}):
            held = held | F.contains(F.col(sentence), F.lit(f))
        sents = sents.where(held)
    keep_h = HashFilter(e, "_h", ("_n",))
    longest = keep_h.most["_n"]
    if longest is None or longest == 1:
        once = sents.select(*keep, sentence, F.explode(F.array_distinct(toks)).alias("_tokens"))
        once = once.where(keep_h.may_hold(F.xxhash64("_tokens")))
        return once.join(e.drop("_n", "_h"), "_tokens").select(*keep, sentence, name, *carry)
    rows = sents.select(*keep, sentence, F.monotonically_increasing_id().alias("_row"), toks.alias("_t"))
    at = rows.select("*", _places("_t").alias("_p", "_tokens"))
    first = HashFilter(e.select(F.xxhash64(F.split_part("_tokens", F.lit(" "), F.lit(1))).alias("_f")), "_f")
    at = at.where(first.may_hold(F.xxhash64("_tokens")))
    tried = at.select(*keep, sentence, "_row", "_p", "_t", F.explode(F.sequence(
        F.lit(1), F.least(F.lit(longest), F.size("_t") - F.col("_p")))).alias("_n"))
    tried = tried.select(*keep, sentence, "_row", "_p", "_n", F.array_join(
        F.slice("_t", F.col("_p") + 1, F.col("_n")), " ").alias("_tokens"))
    tried = tried.where(keep_h.may_hold(F.xxhash64("_tokens")))
    found = tried.join(e.select("_tokens").distinct(), "_tokens", "left_semi")
    chosen = found.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in (*keep, sentence)],
        F.collect_list(F.struct(F.col("_p").alias("p"), F.col("_n").alias("n"), F.col("_tokens").alias("w"))).alias("_found"))
    chosen = chosen.select(*keep, sentence, F.explode(F.array_distinct(
        F.transform(leftmost_longest(F.col("_found")), lambda x: x["w"]))).alias("_tokens"))
    return chosen.join(e.drop("_n", "_h"), "_tokens").select(*keep, sentence, name, *carry)


def extract_sentiment(df: DataFrame, id_cols: list[str], text: str, lexicon: DataFrame,
                      only: str | None = None) -> DataFrame:
    """(ids..., review_sentence, sentiment, sentiment_word): one row per
    sentence occurrence and distinct polar entry in it."""
    lex = lexicon if only is None else lexicon.where(F.col("sentiment") == only)
    lex = lex.select(F.col("word").alias("sentiment_word"), "sentiment")
    return occurrences(sentences(df, text, id_cols), "review_sentence", id_cols, lex, "sentiment_word", ["sentiment"]).select(
        *id_cols, "review_sentence", "sentiment", "sentiment_word")


def find_company(df: DataFrame, id_cols: list[str], text: str, names: DataFrame,
                 name: str = "name") -> DataFrame:
    """(ids..., company_name, review_sentence): one row per sentence
    occurrence and distinct dictionary name in it (any case, whole tokens, the
    longest name at each place)."""
    n = names.select(F.col(name).alias("company_name"))
    return occurrences(sentences(df, text, id_cols), "review_sentence", id_cols, n, "company_name").select(
        *id_cols, "company_name", "review_sentence")


# -- a lexicon learned from labels -------------------------------------------

def learn_lexicon(df: DataFrame, text: str, negative: str, weight: float = 0.01, least_z: float = 3.0,
                  least_count: int = 5) -> DataFrame:
    """(word, log_odds, z, sentiment) of the words that tell the classes apart.

    ``negative`` is a boolean column: true and false rows are the classes, null
    rows (no label) count for the prior only. The log-odds of a word between the
    classes use the whole corpus as an informative Dirichlet prior (each class
    gets ``weight`` of the corpus counts on top of its own), and z is the
    log-odds over its standard deviation. Words of at least ``least_count``
    labelled occurrences and |z| >= ``least_z`` stay: NEG if they speak for the
    true class, POS else. One pass over the texts, one aggregate by word, whose
    counts are written once.
    """
    words = df.select(F.col(negative).alias("_neg"), F.explode(
        F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD_RE), F.lit(0))).alias("word"))
    c = words.groupBy("word").agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col("_neg")).alias("_a"),
                                  F.count_if(~F.col("_neg")).alias("_b"))
    c = ctas_temp(df.sparkSession, c, "word-counts")
    total = c.agg(F.sum("_all").alias("_n"), F.sum("_a").alias("_na"), F.sum("_b").alias("_nb")).first()
    n, na, nb = (float(v or 0) for v in total)
    prior = F.col("_all") * F.lit(weight)

    def odds(count, size):
        y = F.col(count) + prior
        return F.ln(y / (F.lit(size + weight * n) - y))
    log_odds = odds("_a", na) - odds("_b", nb)
    sd = F.sqrt(1 / (F.col("_a") + prior) + 1 / (F.col("_b") + prior))
    out = c.where(F.col("_a") + F.col("_b") >= least_count).select(
        "word", F.round(log_odds, 6).alias("log_odds"), F.round(log_odds / sd, 6).alias("z"))
    return out.where(F.abs("z") >= least_z).withColumn("sentiment", F.when(F.col("z") > 0, "NEG").otherwise("POS"))


def extract_polarity(df: DataFrame, id_cols: list[str], text: str, lexicon: DataFrame,
                     negators=NEGATORS, scope: int = SCOPE) -> DataFrame:
    """(ids..., review_sentence, sentiment_word, sentiment, hits): polar words of
    every sentence occurrence with the negation scope resolved: a word within
    ``scope`` tokens after a negator of its sentence has the other polarity.
    ``hits`` counts the word's occurrences of that polarity. The lexicon holds
    single words.

    Words are counted where the sentence is read: its tokens, marked + or - for
    negated, are sorted, and each distinct one becomes a row with its counts. So a
    sentence is never shuffled to be grouped, and its rows stay together. Only a
    lexicon of more than ``SMALL`` words may shuffle them, to be joined."""
    lex = lexicon.select(F.lower("word").alias("_w"), "sentiment").distinct()
    turned = F.when(F.col("sentiment") == "POS", "NEG").otherwise("POS")
    # what an occurrence means: entries of a word by polarity, plain and negated
    means = lex.select("_w", F.explode(F.array(
        F.struct(F.col("sentiment"), F.lit(1).alias("p"), F.lit(0).alias("n")),
        F.struct(turned.alias("sentiment"), F.lit(0).alias("p"), F.lit(1).alias("n")))).alias("_x"))
    means = means.groupBy("_w", "_x.sentiment").agg(F.sum("_x.p").alias("_as_plain"), F.sum("_x.n").alias("_as_neg"))
    means = ctas_temp(df.sparkSession, means, "polarity")
    if means.count() <= 2 * SMALL:
        means = F.broadcast(means)
    keep_h = HashFilter(lex.select(F.xxhash64("_w").alias("_h")), "_h")
    no = F.array(*[F.lit(w) for w in negators])
    # no token holds a space, so the marked forms of a word are neighbours when sorted
    plain, neg = F.lit(" +"), F.lit(" -")

    def marked(w, p):
        before = F.slice("_t", F.greatest(p - F.lit(scope), F.lit(0)) + 1, F.least(p, F.lit(scope)))
        return F.concat(w, F.when(F.arrays_overlap(before, no), neg).otherwise(plain))
    rows = sentences(df, text, id_cols).select("*", tokens(F.col("review_sentence")).alias("_t"))
    rows = rows.select(*id_cols, "review_sentence", F.sort_array(
        F.when(F.arrays_overlap("_t", no), F.transform("_t", marked)).otherwise(
            F.transform("_t", lambda w: F.concat(w, plain)))).alias("_s"))
    rows = rows.select("*", F.filter(F.sequence(F.lit(0), F.greatest(F.size("_s") - 1, F.lit(0))), lambda i: (i == 0) | (
        F.get("_s", i) != F.get("_s", i - 1))).alias("_starts"))
    at = rows.select("*", _places("_starts").alias("_k", "_at"))

    def ends(k):  # where the run that begins at place k of the starts ends
        return F.coalesce(F.get("_starts", k + 1), F.size("_s"))
    k, key, count = F.col("_k"), F.get("_s", F.col("_at")), ends(F.col("_k")) - F.col("_at")
    word = F.substring(key, F.lit(1), F.length(key) - 2)
    at = at.select(*id_cols, "review_sentence", word.alias("_w"), F.endswith(key, neg).alias("_neg"), count.alias("_c"),
                   F.get("_s", F.col("_at") - 1).alias("_before"), F.get("_s", ends(k)).alias("_after"),
                   (ends(k + 1) - ends(k)).alias("_c_after"))
    at = at.where(keep_h.may_hold(F.xxhash64("_w")))
    # a word of both forms is one row, that of the plain form
    at = at.where(~F.col("_neg") | F.col("_before").isNull() | (F.col("_before") != F.concat("_w", plain)))
    both = F.coalesce(F.col("_after") == F.concat("_w", neg), F.lit(False))
    at = at.select(*id_cols, "review_sentence", "_w", F.when(F.col("_neg"), 0).otherwise(F.col("_c")).alias("_plain"),
                   F.when(F.col("_neg"), F.col("_c")).when(both, F.col("_c_after")).otherwise(0).alias("_negated"))
    polar = at.join(means, "_w").withColumn(
        "hits", F.col("_plain") * F.col("_as_plain") + F.col("_negated") * F.col("_as_neg")).where("hits > 0")
    return polar.select(*id_cols, "review_sentence", F.col("_w").alias("sentiment_word"), "sentiment", "hits")
