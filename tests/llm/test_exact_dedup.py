import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm.exact_dedup import cut_points, exact_dedup


def brute(rows):
    norm = {}
    out = []
    for i, (d, t) in enumerate(rows):
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append((d is None, d if d is not None else 0, i))
    for n, members in norm.items():
        first = min(members)
        for null, d, i in members:
            out.append((None if null else d, None if first[0] else first[1], len(members), (null, d, i) == first,
                        hashlib.sha256(n.encode()).hexdigest()))
    return out


def key(r):
    return tuple("" if x is None else str(x) for x in r)


ROWS = [(3, "a  b"), (1, "a b"), (2, "a\tb"), (4, None), (5, ""), (6, " "), (7, "\n"), (None, "a b"), (8, "A b"), (9, "é\x0bü"),
        (10, "é ü"), (11, "x" * 50_000), (12, "x" * 50_000), (13, "x" * 50_001)]


@pytest.mark.parametrize("id_bytes", [16, 1])
def test_matches_brute_force(docs_of, id_bytes):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    long = [" ".join(rnd.choice(words) for _ in range(1500)) for _ in range(12)]
    rows = ROWS + [(100 + i, long[i % 12] + (" end" if i % 5 == 0 else "")) for i in range(40)]
    # One-byte identifiers clash everywhere: results must stay right.
    got = [tuple(r) for r in exact_dedup(docs_of(rows), id_bytes=id_bytes).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_repeated_rows_keep_exactly_one(docs_of):
    got = exact_dedup(docs_of([(1, "a"), (1, "a"), (1, "a"), (2, "b")])).collect()
    assert sorted((r.doc_id, r.group_size, r.kept) for r in got) == [(1, 3, False), (1, 3, False), (1, 3, True), (2, 1, True)]


def test_empty_table_and_clashing_columns(docs_of):
    assert exact_dedup(docs_of([]).limit(0)).count() == 0
    d = docs_of([(1, "a"), (2, "a")]).withColumn("recipe", F.lit(1)).withColumn("__key", F.lit(2)).withColumn("kept", F.lit(3))
    assert sorted((r.doc_id, r.kept) for r in exact_dedup(d).collect()) == [(1, True), (2, False)]


def test_cuts_depend_on_content_only():
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 123, 20_000).astype(np.uint8)
    a = np.concatenate([rng.integers(97, 123, 777).astype(np.uint8), passage])
    two = np.concatenate([passage, a])
    bounds, first = cut_points(two, np.array([0, len(passage), len(two)]))
    alone = set(bounds[first[0]:first[1] + 1].tolist())
    shifted = {b - len(passage) - 777 for b in bounds[first[1]:].tolist()}
    assert len(alone & shifted) > 10
    assert (np.diff(bounds) <= 8192).all()


def test_tables_are_cleared_with_the_application(spark, docs_of, tmp_path):
    import glob

    from basketry.llm.common import saved
    from basketry.session import clear_scratch, shared_root
    saved(docs_of([(1, "a")]), "kept-no-longer")
    found = f"{shared_root(spark).removeprefix('file:')}/basketry-scratch/*/llm-kept-no-longer-*"
    assert glob.glob(found)
    clear_scratch(spark)
    assert not glob.glob(found)
