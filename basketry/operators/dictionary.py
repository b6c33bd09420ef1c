"""Dictionaries met by hash: a bitmap of the entries' hashes is tested where the
text is read, so that only words (or windows of words) that an entry may equal
become rows; an equi join with the entries then decides exactly.

The bitmap travels as one literal of fixed size: ``BITS`` bits an entry, never
more than ``MOST`` bits in all. A dictionary that outgrows it lets more
candidates pass, which the join refuses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32
MOST = 1 << 21

# A token is a run of letters, a run of digits, or one other sign.
TOKEN_RE = "\\p{L}+|\\p{N}+|[^\\p{L}\\p{N}\\x09-\\x0D\\x20]"


class HashFilter:
    """Which 64-bit hashes may be among those of a column (no false negatives).
    ``most`` columns come with their maximum, in ``self.most``, from the same job;
    ``bits`` fixes the size of the bitmap (else by the number of hashes)."""

    def __init__(self, hashes: DataFrame, column: str, most: tuple[str, ...] = (), bits: int | None = None):
        word = F.shiftright(F.col(column).bitwiseAND(F.lit(MOST - 1)), 6).cast("int")
        bit = F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))")
        # At most MOST / 64 rows.
        rows = hashes.select("*", word.alias("__w"), bit.alias("__b")).groupBy("__w").agg(
            F.bit_or("__b").alias("__b"), *[F.max(c).alias(c) for c in most]).collect()
        self.most = {c: max((r[c] for r in rows if r[c] is not None), default=None) for c in most}
        held = {r["__w"]: r["__b"] for r in rows}
        set_bits = sum((b & (2 ** 64 - 1)).bit_count() for b in held.values())
        bits, wanted = bits or 1 << 10, 0 if bits else BITS * set_bits
        while bits < min(MOST, wanted):
            bits *= 2
        self.mask = bits - 1
        words = [0] * (bits // 64)
        for w, b in held.items():
            words[w % len(words)] |= b
        # folded by Catalyst into one literal array
        self.bits = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")

    def may_hold(self, h: Column) -> Column:
        word = F.get(self.bits, F.shiftright(h.bitwiseAND(F.lit(self.mask)), 6).cast("int"))
        return F.getbit(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_RE), F.lit(0))


def entries(names: DataFrame, name: str, carry: list[str] | tuple = ()) -> DataFrame:
    """Distinct lower-cased entries: ``name``, ``carry``, ``_tokens`` (joined by one
    space), ``_n`` (how many) and ``_h`` (hash). An entry without a token is none."""
    t = tokens(F.col(name))
    e = names.select(F.lower(F.col(name)).alias(name), *carry).select(
        name, *carry, F.array_join(t, " ").alias("_tokens"), F.size(t).alias("_n"))
    return e.where("_n > 0").distinct().withColumn("_h", F.xxhash64("_tokens"))


def leftmost_longest(found: Column) -> Column:
    """Of matches (p, n, and more) those that a scan from the left takes, at each
    place the longest, none overlapping."""
    # by place, longest first: all but the first of a place overlap it
    order = F.array_sort(found, lambda a, b: F.when(a["p"] != b["p"], a["p"] - b["p"]).otherwise(b["n"] - a["n"]))
    empty = F.slice(found, 1, 0)
    return F.reduce(order, F.struct(F.lit(0).alias("e"), empty.alias("hits")),
                    lambda s, x: F.when(x["p"] >= s["e"], F.struct((x["p"] + x["n"]).alias("e"),
                                                                 F.concat(s["hits"], F.array(x)).alias("hits"))).otherwise(s),
                    lambda s: s["hits"])
