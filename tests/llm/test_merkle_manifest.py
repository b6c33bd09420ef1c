import random
import zlib
from collections import defaultdict
from hashlib import sha256

from basketry.llm.merkle_manifest import manifest


def h(text):
    return sha256(text.encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree(nodes):
    """Top of the tree and, for each node, its siblings (left, right) by level."""
    paths = [[] for _ in nodes]
    level, members = nodes, [[k] for k in range(len(nodes))]
    while len(level) > 1:
        for k, below in enumerate(members):
            a = k - k % 8
            for m in below:
                paths[m].append(("".join(level[a:k]), "".join(level[k + 1:a + 8])))
        level = [h("".join(level[k:k + 8])) for k in range(0, len(level), 8)]
        members = [sum(members[k:k + 8], []) for k in range(0, len(members), 8)]
    return level[0], paths


def brute(rows):
    """(doc_id, text, lang, source, n_chars) -> sorted result rows."""
    groups = defaultdict(list)
    for d, t, lang, s, n in rows:
        leaf, low = (h("".join(part(v) for v in (d, s, lang, n, x))) for x in (t, lowered(t)))
        tampered = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        groups[lang].append((d is not None, d or 0, leaf, d, low if tampered else leaf))
    tops = {}
    for lang, leaves in groups.items():
        leaves.sort()
        tops[lang] = tree([x[2] for x in leaves])
    langs = sorted(tops, key=lambda g: (g is not None, (g or "").encode()))
    root, above = tree([tops[g][0] for g in langs])
    out = []
    for g, up in zip(langs, above):
        for x, own in zip(groups[g], tops[g][1]):
            node = x[4]
            for a, z in own + up:
                node = h(a + node + z)
            out.append((x[3], x[2], tops[g][0], root, h("".join(a + z for a, z in own + up)), node, node == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, word long, i int, leaf string"


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 7, 1, "y") for r in rows], SCHEMA)
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, manifest(df).select(*cols).collect()), key=str) == brute(rows)


def row(d, rnd, lang="en"):
    text = "".join(rnd.choice("aB é\n") for _ in range(rnd.randrange(12)))
    return d, text, lang, rnd.choice(["s", None, ""]), len(text)


def test_against_brute_force_with_odd_rows(spark):
    rnd = random.Random(4)
    ids = [*range(-70, 130), *(rnd.randrange(-2**63, 2**63) for _ in range(300)), 2**63 - 1, -2**63]
    rows = [row(d, rnd, rnd.choice(["en", "de", None, "", "é", "zz"])) for d in dict.fromkeys(ids)]
    rows += [row(None, rnd, rnd.choice(["en", None])) for _ in range(12)]            # null ids
    rows += [(5, None, "en", None, None), (6, "A" * 300_000, "de", "s", 1), (None, None, None, None, None)]
    rows += [row(rnd.choice([63, 64, 65]), rnd, "en") for _ in range(40)] + [rows[3]] * 5  # repeated ids and rows
    check(spark, rows)


def test_a_language_of_more_than_one_block(spark):
    rnd = random.Random(5)
    check(spark, [row(3 * d, rnd, "en" if d % 9 else "fr") for d in range(4096 + 1200)])


def test_single_leaf_and_exact_powers(spark):
    rnd = random.Random(6)
    check(spark, [row(9, rnd)])
    check(spark, [row(d, rnd) for d in range(64)] + [row(900 + d, rnd, "de") for d in range(8)] + [row(1, rnd, None)])


def test_many_languages(spark):
    rnd = random.Random(7)
    check(spark, [row(d, rnd, f"l{d % 77}") for d in range(200)])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest(df).collect() == []
