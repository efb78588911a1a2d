"""SQL that checks the queries, written for DuckDB from the operators' definitions."""

from __future__ import annotations

_WORDS = "[x for x in string_split(coalesce({text}, ''), ' ') if x <> '']"
_GRAMS = "list_transform(range(1, len(w) - 1), lambda i: CAST('0x' || substr(md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]), 1, 8) AS BIGINT))"

DOCS = f"""
s_doc AS (SELECT folder, file, {_GRAMS} AS items FROM (SELECT source AS folder, doc_id AS file, {_WORDS.format(text="text")} AS w FROM documents) WHERE len(w) >= 3),
i_doc AS (SELECT folder, file, pos, v, v >> 16 AS key FROM (SELECT folder, file, unnest(items) AS v, unnest(range(0, len(items))) AS pos FROM s_doc)),
l_doc AS (SELECT folder, file, len(items) AS n FROM s_doc),
k_doc AS (SELECT *, count(*) OVER (PARTITION BY folder, file, key) AS bucket FROM i_doc)"""
PATTERNS = f"""
s_pat AS (SELECT file, {_GRAMS} AS items FROM (SELECT item_id AS file, {_WORDS.format(text="text")} AS w FROM benchmark) WHERE len(w) >= 3),
i_pat AS (SELECT file, pos, v, v >> 16 AS key FROM (SELECT file, unnest(items) AS v, unnest(range(0, len(items))) AS pos FROM s_pat)),
l_pat AS (SELECT file, len(items) AS n FROM s_pat)"""

#: Patterns against documents: votes, candidates, whole coverage.
_CANDS = """
cand AS (
  SELECT *, CASE WHEN strong > 8 THEN rank ELSE row_number() OVER (PARTITION BY {pair} ORDER BY lo, off) END AS turn
  FROM (SELECT *, row_number() OVER (PARTITION BY {pair} ORDER BY votes DESC, off DESC) AS rank, count(*) OVER (PARTITION BY {pair}) AS strong
        FROM votes WHERE votes >= 3 AND hi - lo <= votes * 40)
  WHERE rank <= 8)"""
MATCHED = f"""{DOCS},{PATTERNS},
votes AS (
  SELECT a.file AS a, b.file AS b, b.pos - a.pos AS off, count(*) AS votes, min(a.pos) AS lo, max(a.pos) AS hi
  FROM i_pat a JOIN k_doc b ON a.key = b.key WHERE b.bucket <= 48 GROUP BY ALL),{_CANDS.format(pair="a, b")},
hits AS (
  SELECT c.a, c.b, c.off, c.turn, x.pos FROM cand c JOIN i_pat x ON x.file = c.a JOIN i_doc y ON y.file = c.b AND y.pos = x.pos + c.off
  WHERE bit_count(xor(x.v, y.v)) <= 8),
fit AS (
  SELECT h.a, h.b, h.off, h.turn, count(*) AS n, any_value(l.n) AS na, count(*) / any_value(l.n) AS ratio,
         greatest(0, min(h.pos) + h.off) AS s, least(any_value(m.n), max(h.pos) + h.off + 1) AS e
  FROM hits h JOIN l_pat l ON l.file = h.a JOIN l_doc m ON m.file = h.b GROUP BY h.a, h.b, h.off, h.turn)"""

_RUNS = """
{out} AS (
  SELECT {by}, min(pos) AS s, max(pos) + 1 AS e, count(*) AS n
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY {by} ORDER BY pos) AS run
        FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY {by} ORDER BY pos) - 1 <= {gap} THEN 0 ELSE 1 END AS fresh FROM {of}))
  GROUP BY {by}, run HAVING max(pos) + 1 - min(pos) >= {least} AND count(*) / (max(pos) + 1 - min(pos)) >= 0.5)"""

#: Documents of a source against each other: verified runs, counts, segments.
PAIRED = f"""{DOCS},
votes AS (
  SELECT a.folder, a.file AS a, b.file AS b, b.pos - a.pos AS off, count(*) AS votes, min(a.pos) AS lo, max(a.pos) AS hi
  FROM i_doc a JOIN k_doc b ON a.folder = b.folder AND a.key = b.key AND a.file < b.file WHERE b.bucket <= 48 GROUP BY ALL),{_CANDS.format(pair="folder, a, b")},
near AS (
  SELECT c.folder, c.a, c.b, c.off, greatest(0, c.lo - 48, -c.off) AS f, least(c.hi + 49, x.n, y.n - c.off) AS t
  FROM cand c JOIN l_doc x ON x.file = c.a JOIN l_doc y ON y.file = c.b),
seen AS (
  SELECT c.folder, c.a, c.b, c.off, x.pos FROM near c JOIN i_doc x ON x.file = c.a AND x.pos >= c.f AND x.pos < c.t JOIN i_doc y ON y.file = c.b AND y.pos = x.pos + c.off
  WHERE c.t - c.f >= 10 AND bit_count(xor(x.v, y.v)) <= 8),{_RUNS.format(out="pair_run", by="folder, a, b, off", gap=1, of="seen", least=10)},
credit AS (
  SELECT DISTINCT folder, file, peer, pos FROM (
    SELECT folder, a AS file, b AS peer, unnest(range(s, e)) AS pos FROM pair_run
    UNION ALL SELECT folder, b, a, unnest(range(s + off, e + off)) FROM pair_run)),
counted AS (SELECT folder, file, pos, count(*) AS n FROM credit GROUP BY ALL),{_RUNS.format(out="segment", by="folder, file", gap=1, of="counted", least=10)}"""

_START = "(epoch_us(ts) - 1704067200000000) / 1000000.0"
EVENTS = f"""
clip AS (
  SELECT event_id AS id, user_id AS file, (event_id * 7 + user_id) % 40 AS pattern_id, {_START} AS s, {_START} + value * 60.0 AS e FROM events),
pat AS (SELECT DISTINCT pattern_id AS id, CASE pattern_id % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'dismissed' ELSE 'pending' END AS status FROM clip),
merged AS (
  SELECT file, min(s) AS s, max(e) AS e
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g
        FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
              FROM clip WHERE e > s))
  GROUP BY file, g),
hours AS (SELECT DISTINCT user_id AS file, CAST(floor({_START} / 3600) AS BIGINT) AS pos FROM events)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.lstrip()}\n{select}"


ORACLES: dict[str, str] = {
    "classify_ext": """
        SELECT path, CASE WHEN ext IN ('mp3', 'm4a', 'aac', 'flac', 'ogg', 'opus', 'wav', 'wma', 'm4b') THEN 'audio'
                          WHEN ext IN ('mp4', 'mkv', 'mov', 'avi', 'webm', 'm4v', 'flv', 'wmv', 'ts', 'mpg', 'mpeg') THEN 'video' END AS kind
        FROM (SELECT path, lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) AS ext
              FROM (SELECT source || '/ep ' || doc_id || '.' || ['mp3', 'MKV', 'txt', 'm4b', 'webm', 'tar.gz', 'ts'][1 + doc_id % 7] AS path FROM documents))""",
    "items_match": """
        SELECT id, bits, bits <= 8 AS matches, bits <= 16 AS loosely
        FROM (SELECT id, bit_count(xor(a, b)) AS bits
              FROM (SELECT o_orderkey AS id, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) AS a,
                           CAST('0x' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 8) AS BIGINT) AS b FROM orders))""",
    "key_mask": """
        SELECT o_orderkey AS id, CAST('0x' || substr(m, 1, 8) AS BIGINT) >> 16 AS key32, CAST(CAST('0x' || substr(m, 1, 16) AS UBIGINT) >> 48 AS BIGINT) AS key64
        FROM (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS m FROM orders)""",
    "dhash_items": """
        SELECT vec_id, CAST(coalesce(sum(CASE WHEN x THEN CAST(1 AS BIGINT) << k ELSE 0 END), 0) AS BIGINT) AS hash
        FROM (SELECT vec_id, unnest(range(0, len(embedding) - 1)) AS k, unnest(list_transform(range(1, len(embedding)), lambda i: embedding[i + 1] > embedding[i])) AS x FROM embeddings)
        GROUP BY vec_id""",
    "seed_index": _with(DOCS, "SELECT folder, file, key, count(*) AS n FROM i_doc GROUP BY ALL"),
    "candidate_offsets": _with(MATCHED, "SELECT a, b, off, votes, lo, hi, turn FROM cand"),
    "coverage_at": _with(MATCHED, "SELECT a, b, off, count(*) AS n, min(pos) AS first, max(pos) AS last FROM hits GROUP BY a, b, off"),
    "match_cover": _with(MATCHED, "SELECT DISTINCT a, b, pos FROM hits"),
    "best_ratio": _with(MATCHED, "SELECT a, b, round(max(ratio), 6) AS ratio FROM fit GROUP BY a, b"),
    "locate": _with(MATCHED, "SELECT a, b, s AS start, e AS \"end\", n FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, turn) AS k FROM fit) WHERE k = 1 AND ratio >= 0.55"),
    "locate_all": _with(
        MATCHED
        + """,
ordered AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, s DESC, e DESC) AS k FROM fit WHERE ratio >= 0.55 AND e > s),
taken AS (
  SELECT a, b, 1 AS k, true AS keep, s, e, [{'s': s, 'e': e}] AS so_far FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.a, o.b, o.k, len(list_filter(t.so_far, lambda x: o.e > x.s AND o.s < x.e)) = 0, o.s, o.e,
         CASE WHEN len(list_filter(t.so_far, lambda x: o.e > x.s AND o.s < x.e)) = 0 THEN list_append(t.so_far, {'s': o.s, 'e': o.e}) ELSE t.so_far END
  FROM taken t JOIN ordered o ON o.a = t.a AND o.b = t.b AND o.k = t.k + 1)""",
        'SELECT a, b, s AS start, e AS "end" FROM taken WHERE keep',
    ),
    "pair_runs": _with(PAIRED, 'SELECT folder, a, b, off, s AS start, e AS "end" FROM pair_run'),
    "recurrence_counts": _with(PAIRED, "SELECT folder, file, pos, n FROM counted"),
    "recurring_segments": _with(PAIRED, 'SELECT folder, file, s AS start, e AS "end", CAST(s AS DOUBLE) AS start_sec, CAST(e AS DOUBLE) AS end_sec, n FROM segment'),
    "length_compatible_pairs": _with(
        PAIRED, "SELECT x.folder, x.file AS file_a, x.s AS start_a, y.file AS file_b, y.s AS start_b FROM segment x JOIN segment y ON x.folder = y.folder AND (x.file, x.s) < (y.file, y.s) WHERE abs((y.e - y.s) - (x.e - x.s)) / greatest(y.e - y.s, x.e - x.s) <= 0.2"
    ),
    "runs": _with(EVENTS + "," + _RUNS.format(out="found", by="file", gap=3, of="hours", least=4), 'SELECT file, s AS start, e AS "end", n FROM found'),
    "merge_ranges": _with(EVENTS, 'SELECT file, round(s, 3) AS start, round(e, 3) AS "end" FROM merged'),
    "saved_seconds": _with(EVENTS, "SELECT file, round(sum(e - s), 3) AS saved FROM merged GROUP BY file"),
    "complement": _with(
        EVENTS
        + """,
whole AS (SELECT DISTINCT file, CAST(2000000.0 AS DOUBLE) AS d FROM clip),
inner_ AS (SELECT w.file, greatest(0.0, m.s) AS s, least(w.d, m.e) AS e FROM merged m JOIN whole w USING (file) WHERE least(w.d, m.e) > greatest(0.0, m.s)),
gaps AS (SELECT file, coalesce(lag(e) OVER (PARTITION BY file ORDER BY s), 0.0) AS a, s AS b FROM (SELECT * FROM inner_ UNION ALL SELECT file, d, d FROM whole))""",
        'SELECT file, round(a, 3) AS start, round(b, 3) AS "end" FROM gaps WHERE b - a > 0.05',
    ),
    "slice_seconds": _with(
        DOCS,
        """SELECT file, coalesce(list_sum(items[i + 1:j]), 0)::BIGINT AS total, greatest(j - i, 0)::BIGINT AS n
FROM (SELECT file, items, CAST(round_even((file % 10 + 0.5) / 0.5, 0) AS BIGINT) AS i, least(len(items), CAST(round_even((file % 10 + 7.25) / 0.5, 0) AS BIGINT)) AS j FROM s_doc)""",
    ),
    "leader_edges": _with(
        PAIRED
        + """,
s_seg AS (SELECT g.folder, g.file * 1000000 + g.s AS file, g.e - g.s AS d, x.pos - g.s AS pos, x.v, x.key FROM segment g JOIN i_doc x ON x.file = g.file AND x.pos >= g.s AND x.pos < g.e),
k_seg AS (SELECT *, count(*) OVER (PARTITION BY folder, file, key) AS bucket FROM s_seg),
votes2 AS (
  SELECT a.folder, a.file AS a, b.file AS b, a.d AS da, b.d AS db, b.pos - a.pos AS off, count(*) AS votes, min(a.pos) AS lo, max(a.pos) AS hi
  FROM s_seg a JOIN k_seg b ON a.folder = b.folder AND a.key = b.key AND b.file < a.file WHERE b.bucket <= 48 GROUP BY ALL),
cand2 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY folder, a, b ORDER BY votes DESC, off DESC) AS rank FROM votes2 WHERE votes >= 3 AND hi - lo <= votes * 40)
  WHERE rank <= 8 AND abs(da - db) / greatest(da, db) <= 0.2),
fit2 AS (
  SELECT c.folder, c.a, c.b, c.off, count(*) / any_value(c.da) AS ratio FROM cand2 c JOIN s_seg x ON x.folder = c.folder AND x.file = c.a JOIN s_seg y ON y.folder = c.folder AND y.file = c.b AND y.pos = x.pos + c.off
  WHERE bit_count(xor(x.v, y.v)) <= 8 GROUP BY c.folder, c.a, c.b, c.off)""",
        "SELECT folder, a, b, round(max(ratio), 6) AS ratio FROM fit2 GROUP BY folder, a, b HAVING max(ratio) >= 0.6",
    ),
    "clip_exists_antijoin": _with(
        EVENTS,
        """SELECT id, pattern_id % 5 AS pattern_id, file AS file_path FROM clip a WHERE id % 2 = 1 AND NOT EXISTS (
  SELECT 1 FROM clip b WHERE b.id % 2 = 0 AND b.pattern_id % 5 = a.pattern_id % 5 AND b.file = a.file AND abs(b.s / 3600 - a.s / 3600) < 1.0)""",
    ),
    "absorb_pending": _with(
        EVENTS
        + """,
own AS (SELECT c.* FROM clip c JOIN pat p ON p.id = c.pattern_id AND p.status = 'pending'),
sure AS (SELECT c.* FROM clip c JOIN pat p ON p.id = c.pattern_id AND p.status = 'confirmed'),
hit AS (SELECT DISTINCT o.id, o.pattern_id, s.pattern_id AS sure_id FROM own o JOIN sure s ON s.file = o.file WHERE o.e > o.s AND greatest(0, least(o.e, s.e) - greatest(o.s, s.s)) / (o.e - o.s) >= 0.01),
total AS (SELECT pattern_id, count(*) AS n FROM own GROUP BY pattern_id)""",
        "SELECT DISTINCT pattern_id AS id FROM (SELECT pattern_id, sure_id, count(*) AS c FROM hit GROUP BY pattern_id, sure_id) JOIN total USING (pattern_id) WHERE c / n >= 0.01",
    ),
    "dedupe_contained": _with(
        EVENTS
        + """,
c AS (SELECT clip.*, status FROM clip JOIN pat ON pat.id = clip.pattern_id),
walk AS (
  SELECT a.id, a.s, a.e, b.s AS cs, b.e AS ce, greatest(a.s, coalesce(max(b.e) OVER (PARTITION BY a.id ORDER BY b.s NULLS FIRST, b.e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a.s)) AS prev
  FROM c a LEFT JOIN c b ON b.file = a.file AND b.status = a.status AND b.e - b.s < a.e - a.s - 0.000001)""",
        """SELECT id FROM walk GROUP BY id
HAVING NOT bool_or(coalesce(ce > prev AND cs > prev + 60 AND (prev < e - 60 OR prev = s), false)) AND greatest(max(s), coalesce(max(ce), max(s))) >= max(e) - 60""",
    ),
    "covered": _with(
        EVENTS
        + """,
part AS (SELECT file, CAST(floor(s / 86400) AS BIGINT) AS day, s AS cs, s + 7200 AS ce FROM clip),
walk AS (
  SELECT file, day, day * 86400.0 + 28800 AS s, day * 86400.0 + 43200 AS e, cs, ce,
         greatest(day * 86400.0 + 28800, coalesce(max(ce) OVER (PARTITION BY file, day ORDER BY cs, ce ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), day * 86400.0 + 28800)) AS prev
  FROM part)""",
        """SELECT file, day FROM walk GROUP BY file, day
HAVING NOT bool_or(ce > prev AND cs > prev + 7200 AND (prev < e - 7200 OR prev = s)) AND greatest(max(s), max(ce)) >= max(e) - 7200""",
    ),
    "recount_shows": _with(EVENTS, "SELECT p.id, p.status, CAST(count(*) AS INTEGER) AS shows FROM pat p JOIN clip c ON c.pattern_id = p.id WHERE p.id % 10 <> 3 GROUP BY p.id, p.status"),
    "patterns_payload": _with(
        EVENTS,
        """SELECT p.id, p.status, round(p.id * 61.5, 1) AS duration, CAST(row_number() OVER (PARTITION BY p.id ORDER BY c.s, c.id) - 1 AS INTEGER) AS at, c.id AS clip_id, c.id % 3 = 0 AS edited, c.id % 2 = 0 AS has_preview
FROM pat p JOIN clip c ON c.pattern_id = p.id""",
    ),
    "export_markdown_lines": _with(
        EVENTS
        + """,
saved AS (SELECT file, sum(e - s) AS t FROM merged GROUP BY file),
shown AS (SELECT p.id, p.status, count(*) AS n, CAST(round_even(p.id * 61.5, 0) AS BIGINT) AS t FROM pat p JOIN clip c ON c.pattern_id = p.id GROUP BY p.id, p.status),
clocked AS (
  SELECT 3 AS part, id, 0 AS "at", '- **' || status || '** · f · ' AS a, t, ' · seen in ' || n || ' file(s) `#' || id || '`' AS b FROM shown
  UNION ALL SELECT 5, file, 0, '- `u' || file || '` — saved ', CAST(round_even(t, 0) AS BIGINT), '' FROM saved
  UNION ALL SELECT 5, file, 1, '  - 0:00 → ', CAST(round_even(t, 0) AS BIGINT), '' FROM saved)""",
        """SELECT part, id, "at", a || CASE WHEN t >= 3600 THEN (t // 3600) || ':' || lpad(CAST(t % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(t // 60 AS VARCHAR) END || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') || b AS line FROM clocked
UNION ALL SELECT * FROM (VALUES (0, 0, 0, '# Catalogue export'), (0, 0, 1, ''), (2, 0, 0, ''), (2, 0, 1, '## Patterns'), (2, 0, 2, ''), (4, 0, 0, ''), (4, 0, 1, '## Removed segments'), (4, 0, 2, ''))
UNION ALL SELECT 1, 0, 0, '_' || (SELECT count(*) FROM shown) || ' patterns · ' || (SELECT count(*) FROM clip) || ' clips · ' || (SELECT count(*) FROM saved) || ' processed files_'""",
    ),
    "remove_plan": _with(
        EVENTS
        + """,
sure AS (SELECT file, s, e FROM clip JOIN pat ON pat.id = clip.pattern_id AND status = 'confirmed'),
joined AS (
  SELECT file, min(s) AS s, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g
    FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM sure WHERE e > s)) GROUP BY file, g),
dur AS (SELECT DISTINCT file, CASE WHEN file % 7 = 0 THEN 0.0 ELSE 2000000.0 END AS d FROM sure),
cut AS (SELECT file, d, greatest(0.0, s) AS s, least(d, e) AS e FROM joined JOIN dur USING (file) WHERE least(d, e) > greatest(0.0, s)),
gap AS (SELECT file, coalesce(lag(e) OVER (PARTITION BY file ORDER BY s, e), 0.0) AS a, s AS b FROM (SELECT file, s, e FROM cut UNION ALL SELECT file, d, d FROM dur WHERE d > 0)),
keep AS (SELECT file, count(*) AS n, sum(b - a) AS t FROM gap WHERE b - a > 0.05 GROUP BY file),
saved AS (SELECT file, sum(e - s) AS t FROM joined GROUP BY file)""",
        """SELECT 'u' || dur.file || '.' || ['mp3', 'flac', 'wma', 'opus'][1 + dur.file % 4] AS file_path, CAST(n.n AS INTEGER) AS n_removed, CAST(coalesce(keep.n, 0) AS INTEGER) AS n_keep,
       round(coalesce(keep.t, 0.0), 2) AS kept_sec, round(coalesce(saved.t, 0.0), 2) AS saved_sec,
       CASE WHEN dur.file % 5 = 0 THEN 'aac' ELSE ['libmp3lame', 'flac', 'aac', 'libopus'][1 + dur.file % 4] END AS encoder,
       CASE WHEN dur.file % 5 = 0 THEN 'mp4' ELSE ['mp3', 'flac', 'm4a', 'opus'][1 + dur.file % 4] END AS out_ext, keep.n IS NULL AS failed
FROM dur JOIN (SELECT file, count(*) AS n FROM sure GROUP BY file) n USING (file) LEFT JOIN keep USING (file) LEFT JOIN saved USING (file)""",
    ),
    "processed_join": """
        SELECT 'u' || user_id || '.' || ['mp3', 'flac', 'wma', 'opus'][1 + user_id % 4] AS file_name, CASE WHEN user_id % 5 = 0 THEN 'video' ELSE 'audio' END AS kind, user_id % 5 = 0 AS trimmed
        FROM (SELECT DISTINCT user_id FROM events)""",
    "folder_kinds": """
        SELECT 'f' || user_id % 9 AS folder, CASE WHEN bool_or(user_id % 5 = 0) THEN 'video' ELSE 'audio' END AS kind, count(*) AS n_files FROM (SELECT DISTINCT user_id FROM events) GROUP BY ALL""",
    "progress_percent": """
        SELECT event_id, stage, coalesce(round(CASE stage WHEN 'fingerprint' THEN i / 128 * 80.0 WHEN 'detect' THEN 82.0 WHEN 'detect_progress' THEN i / 128 * 15.0 + 82.0 WHEN 'normalize' THEN 97.0
                 WHEN 'preview' THEN least(99.0, event_id % 20 * 0.2 + 97.0) WHEN 'done' THEN 99.0 END, 1), -1.0) AS percent,
               CASE WHEN stage IN ('fingerprint', 'detect_progress') AND i >= 1 THEN CAST(round_even(user_id * 0.5 / i * (128 - i), 0) AS BIGINT) ELSE -1 END AS eta_seconds
        FROM (SELECT event_id, user_id, event_id % 100 AS i, ['fingerprint', 'detect', 'detect_progress', 'matched', 'normalize', 'preview', 'done'][1 + event_id % 7] AS stage FROM events)""",
    "known_match": _with(
        MATCHED
        + """,
ordered AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, s DESC, e DESC) AS k FROM fit WHERE ratio >= 0.55 AND e > s),
taken AS (
  SELECT a, b, 1 AS k, true AS keep, s, e, [{'s': s, 'e': e}] AS so_far FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.a, o.b, o.k, len(list_filter(t.so_far, lambda x: o.e > x.s AND o.s < x.e)) = 0, o.s, o.e,
         CASE WHEN len(list_filter(t.so_far, lambda x: o.e > x.s AND o.s < x.e)) = 0 THEN list_append(t.so_far, {'s': o.s, 'e': o.e}) ELSE t.so_far END
  FROM taken t JOIN ordered o ON o.a = t.a AND o.b = t.b AND o.k = t.k + 1)""",
        'SELECT a AS pattern_id, b AS file_path, CAST(s AS DOUBLE) AS start, CAST(e AS DOUBLE) AS "end" FROM taken WHERE keep AND (a + b) % 2 <> 0',
    ),
}
