"""DuckDB SQL of the training-data queries that SQL can state."""

from basketry.llm.mixing import _PHI_HIGH, _PHI_LOW


def crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text, bit by bit."""
    bits = (f"flatten([[ascii(x), 0, 0, 0, 0, 0, 0, 0] FOR x IN string_split({text}, '')])")
    step = "xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384::BIGINT)"
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda c, b: {step}), 4294967295::BIGINT)")


def _part(value: str) -> str:
    """A field of a manifest leaf."""
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_part(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, levels: int) -> str:
    """CTEs ``name0`` .. ``name<levels>`` (g, i, h, n: nodes of the group at that
    level) above ``name0``; a finished group keeps its single node."""
    return ",".join(f"""
        {name}{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h)
              ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (any_value(n) + 7) // 8 AS n
            FROM {name}{k} GROUP BY g, i // 8)""" for k in range(levels))


def _path(name: str, levels: int, group: str, place: str) -> list[tuple[str, str]]:
    """Text left and right of the ancestors of ``place``, by level ('' above the top)."""
    side = """coalesce((SELECT string_agg(x.h, '' ORDER BY x.i) FROM {t} x WHERE x.g = {g}
              AND x.i // 8 = {p} // 8 AND x.i {op} {p}), '')"""
    return [tuple(side.format(t=f"{name}{k}", g=group, p=f"({place} // {8 ** k})", op=op) for op in "<>")
            for k in range(levels)]


def _manifest(levels: int, groups: int) -> str:
    """Levels above a finished tree have no siblings: their fold is skipped."""
    paths = _path("t", levels, "d.g", "d.i") + _path("s", groups, "''", "r.i")
    cols = ", ".join(f"{a} AS l{k}, {z} AS r{k}" for k, (a, z) in enumerate(paths))
    fold = "shown"
    folds = []
    for k in range(levels + groups):
        top = f"n <= {8 ** k}" if k < levels else f"m <= {8 ** (k - levels)}"
        folds.append(f"f{k + 1} AS (SELECT *, CASE WHEN {top} THEN x{k} ELSE sha256(l{k} || x{k} || r{k}) END AS x{k + 1} FROM f{k})")
    proof = " || ".join(f"l{k} || r{k}" for k in range(levels + groups))
    return f"""
        WITH raw AS (SELECT *, coalesce('=' || lang, '-') AS g, {_leaf('text')} AS leaf, {_leaf(
            "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low FROM documents),
        d AS (SELECT doc_id, g, leaf, CASE WHEN {crc32('doc_id::VARCHAR')} % 3 = 0 THEN low ELSE leaf END AS shown,
              row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM raw),
        t0 AS (SELECT g, i, leaf AS h, n FROM d),{_tree('t', levels)},
        r AS (SELECT g AS name, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS m FROM t{levels}),
        s0 AS (SELECT '' AS g, i, subroot AS h, m AS n FROM r),{_tree('s', groups)},
        f0 AS (SELECT d.doc_id, d.leaf, d.n, r.m, r.subroot, (SELECT h FROM s{groups}) AS root, {fold} AS x0, {cols}
               FROM d JOIN r ON d.g = r.name),
        {", ".join(folds)}
        SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, x{levels + groups} AS folded_root,
               x{levels + groups} = root AS verified FROM f{levels + groups}"""


SQL = {
    "op4_chunk_recipes": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
                   FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
        FROM n JOIN g USING (norm)""",
    # A source's first pass takes its first least(need, size) words, a second
    # pass the rest of the need; documents lie in the order of md5(doc_id). Slots
    # of 64 words follow golden-ratio points; a document's first words are in the
    # slot of its first block.
    "op2_source_schedule": rf"""
        WITH d AS (SELECT doc_id, source,
                     coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                     md5(coalesce(doc_id::VARCHAR, chr(0))) AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size,
                (CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3
                   WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight FROM d GROUP BY source),
        l AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM s),
        v AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
                  - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
              FROM l WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, source_size, round(least(cap, max(level) OVER () * weight), 6) AS target FROM v),
        o AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS need,
                d.source, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        , p AS (SELECT *, CASE WHEN source_size > 0 THEN need // source_size ELSE 0 END AS full_passes FROM (
                SELECT source, source_size, floor(target)::BIGINT AS need, (source_size + 63) // 64 AS blocks FROM t)),
        p2 AS (SELECT *, full_passes * blocks + (need - full_passes * source_size + 63) // 64 AS slots FROM p),
        p3 AS (SELECT *, (sum(slots) OVER (ORDER BY coalesce('s' || source, 'n')) - slots)::BIGINT AS lo,
                 (sum(slots) OVER ())::BIGINT AS n FROM p2),
        u AS (SELECT i, n, (i % 1048576) * {_PHI_LOW!r}::DOUBLE + floor(i / 1048576) * {_PHI_HIGH!r}::DOUBLE AS u
              FROM (SELECT n, unnest(range(n)) AS i FROM (SELECT DISTINCT n FROM p3))),
        hit AS (SELECT p3.source, slots, i, row_number() OVER (PARTITION BY p3.source ORDER BY i) - 1 AS rank
                FROM (SELECT i, least(floor((u - floor(u)) * n), n - 1) AS place FROM u)
                JOIN p3 ON place >= lo AND place < lo + slots),
        slot AS (SELECT source, rank, i AS slot FROM hit WHERE rank < slots
                 UNION ALL SELECT source, rank, n + rank FROM (
                   SELECT p3.source, n, unnest(range(coalesce(have, 0), slots)) AS rank FROM p3
                   LEFT JOIN (SELECT source, count(*) AS have FROM hit GROUP BY source) h ON h.source IS NOT DISTINCT FROM p3.source)),
        k AS (SELECT *, (greatest(least(off + size, least(need, source_size)) - off, 0)
           + greatest(least(off + size, need - least(need, source_size)) - off, 0))::BIGINT AS taken FROM o)
        SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN slot.slot ELSE -1 END AS first_slot
        FROM k LEFT JOIN slot ON slot.source IS NOT DISTINCT FROM k.source AND slot.rank = k.off // 64""",
    "op10_revisit_resolution": r"""
        WITH p AS (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'https://portal.example/?ref=' || page_id ELSE url END AS url,
                     md5(coalesce(html, '')) AS d0, length(coalesce(html, '')) AS n FROM pages),
        v AS (SELECT p.*, k, (k = 0 AND page_id % 13 <> 0) OR (k = 2 AND page_id % 3 = 0) AS is_full,
                CASE WHEN page_id % 3 = 0 AND k >= 2 THEN reverse(d0) ELSE d0 END AS d,
                1704067200 + k * 86400 + page_id * 7919 % 86400 AS ts, page_id * 64 + k AS record_id,
                regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?', 1) AS h,
                regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?', 2) AS pa,
                regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?', 3) AS q
              FROM (SELECT *, unnest(range(3 + page_id % 3 + CASE WHEN page_id % 97 = 0 THEN 40 ELSE 0 END)) AS k FROM p) p),
        u AS (SELECT *, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 11 = 0 AND k = 3 THEN '"stale"'
                  ELSE '"' || substr(d, 1, 16) || '"' END AS etag,
                CASE WHEN page_id % 14 = 0 THEN CASE WHEN page_id % 5 = 0 AND k = 3 THEN 'stale' ELSE 'm' || substr(d, 1, 8) END END AS lm,
                CASE WHEN is_full OR page_id % 4 = 1 THEN d WHEN page_id % 4 = 3 AND k = 1 THEN upper(d) END AS dg,
                regexp_replace(regexp_replace(regexp_replace(lower(h), '^.*@', ''), ':(80|443)?$', ''), '^www\.', '')
                  || regexp_replace(pa, '/+$', '') AS bare,
                array_to_string(list_sort([x FOR x IN string_split(q, '&') IF x <> ''
                  AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')]), '&') AS qs FROM v),
        c AS (SELECT *, bare || CASE WHEN qs <> '' THEN '?' || qs ELSE '' END AS url_key FROM u),
        a AS (SELECT *, last_value(CASE WHEN is_full THEN {'id': record_id, 'etag': etag, 'lm': lm, 'dg': dg, 'n': n, 'ts': ts} END IGNORE NULLS) OVER (
                PARTITION BY url_key ORDER BY ts, is_full, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM c),
        m AS (SELECT *, CASE WHEN etag IS NOT NULL AND r.etag IS NOT NULL THEN etag = r.etag
                  WHEN lm IS NOT NULL AND r.lm IS NOT NULL THEN lm = r.lm
                  WHEN dg IS NOT NULL AND r.dg IS NOT NULL THEN dg = r.dg END AS same FROM a WHERE NOT is_full),
        o AS (SELECT *, CASE WHEN r IS NULL THEN 'no_response' WHEN dg <> r.dg OR NOT same THEN 'validator_mismatch'
                WHEN same IS NULL THEN 'unverified' ELSE 'resolved' END AS outcome FROM m)
        SELECT record_id, url_key, CASE WHEN outcome IN ('resolved', 'unverified') THEN r.id END AS refers_to, outcome,
          CASE WHEN outcome IN ('resolved', 'unverified') THEN 200 END AS status,
          CASE WHEN outcome IN ('resolved', 'unverified') THEN
            'cache-control: max-age=' || k || chr(10) || 'content-length: ' || r.n || chr(10) || 'content-type: text/html' || chr(10)
            || 'date: ' || ts || chr(10) || CASE WHEN r.etag IS NULL THEN '' ELSE 'etag: ' || r.etag || chr(10) END
            || 'expires: ' || (ts + 60) || chr(10) || 'server: origin'
          ELSE 'cache-control: max-age=' || k || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || ts || chr(10)
            || 'expires: ' || (ts + 60) || chr(10) || 'x-cache: HIT' END AS headers
        FROM o""",
    # crc32 bit by bit; levels by 8 as often as the rows of the checked tables
    # can need (8 ** 7 leaves a language, 8 ** 3 languages).
    "op13_bitmap_manifest": _manifest(7, 3),
}
