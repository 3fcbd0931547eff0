"""SQL for DuckDB with the same rows as the queries of .queries, over the driver's tables."""

from __future__ import annotations

from . import folders
from ..operators.batch import BACKUP_EXISTS, LOG_FOLDER, LOG_RULE, LOG_SHEET, LOG_TIME, LOG_TITLE, NO_ROWS, OPEN_FILE, RENAME_FAILED, VERIFY_FAILED, WRITE_FAILED

_TREE = """
base AS (SELECT l_orderkey AS doc, l_linenumber::BIGINT AS ord, CAST(l_quantity AS BIGINT) % 4 AS depth, 'part ' || l_partkey AS title, l_suppkey AS page, l_partkey, l_suppkey, l_extendedprice,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS rn FROM lineitem),
leveled AS (SELECT *, rn + least(0, min(depth - rn) OVER (PARTITION BY doc ORDER BY rn ROWS UNBOUNDED PRECEDING)) AS eff FROM base),
tree AS (SELECT *, list_slice([last_value(CASE WHEN eff = 0 THEN rn END IGNORE NULLS) OVER w, last_value(CASE WHEN eff = 1 THEN rn END IGNORE NULLS) OVER w,
    last_value(CASE WHEN eff = 2 THEN rn END IGNORE NULLS) OVER w, last_value(CASE WHEN eff = 3 THEN rn END IGNORE NULLS) OVER w], 1, eff + 1) AS path
    FROM leveled WINDOW w AS (PARTITION BY doc ORDER BY rn ROWS UNBOUNDED PRECEDING)),
up AS (SELECT *, CASE WHEN len(path) > 1 THEN path[-2] END AS parent FROM tree),
asked AS (SELECT o_orderkey AS doc, o_custkey % 5 AS par, o_custkey % 100 AS p, o_custkey % 7 AS moving, o_orderkey % 5 AS target FROM orders)"""


def _tree(sql: str) -> str:
    return f"WITH {_TREE} {sql}"


_NUMBER = "SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY k1, k2, rn) - 1 AS rn, eff, title, page FROM"


def _insert(at: str, by_page: bool) -> str:
    spot = {
        "parent": "CASE WHEN f.p_eff IS NOT NULL THEN {} END",
        "anchor": "CASE WHEN a.par IS NULL AND f.anchor IS NOT NULL THEN {} END",
        "root": "CASE WHEN f.root IS NOT NULL THEN {} END",
    }
    rules = {"k1": [], "k2": [], "eff": []}
    if by_page:
        rules["k1"] += ["CASE WHEN f.p_eff IS NOT NULL THEN f.child END"]
        rules["k2"] += ["CASE WHEN f.p_eff IS NOT NULL AND f.child IS NOT NULL THEN -1 END"]
    for k, v in (("k1", "f.p_end"), ("k2", "1"), ("eff", "f.p_eff + 1")):
        rules[k].append(spot["parent"].format(v))
    if by_page:
        for k, v in (("k1", "(SELECT max(t.rn) FROM tree t WHERE t.doc = a.doc AND list_contains(t.path, f.anchor))"), ("k2", "1"), ("eff", "f.a_eff")):
            rules[k].append(spot["anchor"].format(v))
        for k, v in (("k1", "f.root"), ("k2", "-1"), ("eff", "0")):
            rules[k].append(spot["root"].format(v))
    for k, v in (("k1", "f.last"), ("k1", "-1"), ("k2", "1"), ("eff", "0")):
        rules[k].append(v)
    one = {k: f"coalesce({', '.join(v)})" for k, v in rules.items()}
    return _tree(f""", a AS (SELECT doc, {at} AS par, p FROM asked),
        f AS (SELECT a.doc, max(CASE WHEN t.rn = a.par THEN t.eff END) AS p_eff, max(CASE WHEN list_contains(t.path, a.par) THEN t.rn END) AS p_end,
            min(CASE WHEN t.page > a.p AND t.parent = a.par THEN t.rn END) AS child, min(CASE WHEN t.page > a.p AND t.eff = 0 THEN t.rn END) AS root,
            max(CASE WHEN t.page <= a.p THEN t.rn END) AS anchor, arg_max(t.eff, t.rn) FILTER (WHERE t.page <= a.p) AS a_eff, max(t.rn) AS last
            FROM up t JOIN a USING (doc) GROUP BY a.doc),
        u AS (SELECT doc, rn AS k1, 0 AS k2, rn, eff, title, page FROM tree
            UNION ALL SELECT a.doc, {one['k1']}, {one['k2']}, -1, {one['eff']}, '새 북마크', a.p FROM a LEFT JOIN f USING (doc))
        {_NUMBER} u""")


_FACTS = """, facts AS (SELECT a.doc, max(CASE WHEN t.rn = a.moving THEN t.eff END) AS m_eff, max(CASE WHEN t.rn = a.target THEN t.eff END) AS t_eff,
        bool_or(t.rn = a.target AND list_contains(t.path, a.moving)) AS below FROM tree t JOIN asked a USING (doc) GROUP BY a.doc),
    checked AS (SELECT a.*, f.m_eff, f.t_eff, CASE WHEN a.moving = a.target OR coalesce(f.below, false) THEN 'InvalidMoveIntoDescendant'
        WHEN f.m_eff IS NULL OR f.t_eff IS NULL THEN 'TargetNotFound' END AS error FROM asked a LEFT JOIN facts f USING (doc))"""


def _move(position: str) -> str:
    k1, k2 = ("target", -1) if position == "Before" else ("last", 1)
    return _tree(f"""{_FACTS}, good AS (SELECT doc, moving, target, t_eff + {int(position == 'Inside')} - m_eff AS delta FROM checked WHERE error IS NULL),
        j AS (SELECT t.*, g.target, g.delta, coalesce(list_contains(t.path, g.moving), false) AS moved, list_contains(t.path, g.target) AS under FROM tree t LEFT JOIN good g USING (doc)),
        e AS (SELECT *, max(CASE WHEN NOT moved AND under THEN rn END) OVER (PARTITION BY doc) AS last FROM j),
        u AS (SELECT doc, CASE WHEN moved THEN {k1} ELSE rn END AS k1, CASE WHEN moved THEN {k2} ELSE 0 END AS k2, rn, eff + CASE WHEN moved THEN delta ELSE 0 END AS eff, title, page FROM e)
        {_NUMBER} u""")


_FILES = """, named AS (SELECT *, coalesce(doc % 3 <> 0 AND l_partkey % 3 <> 0 AND l_partkey % 7 <> 1, false) AS own FROM base)"""

_SEEN = """, seen AS (SELECT t.* FROM tree t LEFT JOIN asked a USING (doc) WHERE a.doc IS NULL OR NOT list_has_any(list_slice(t.path, 1, len(t.path) - 1), [a.par, a.moving]))"""

_BATCH = """WITH src AS (SELECT n_nationkey, path, row_number() OVER (ORDER BY NOT lower(path) LIKE '%.xlsx', string_split(path, '/')) AS rank FROM
        (SELECT n_nationkey, ['a', 'a-b', 'c/d'][n_nationkey % 3 + 1] || '/sheet' || n_nationkey || CASE WHEN n_nationkey % 4 = 0 THEN '.xlsx' ELSE '.csv' END AS path FROM nation)),
    sheet AS (SELECT rank, 'file' || s_suppkey % 37 || '.pdf' AS key, s_suppkey % 11 AS ord, s_suppkey AS src_row, s_name AS title FROM supplier JOIN src ON s_nationkey = n_nationkey),
    first AS (SELECT *, min(rank) OVER (PARTITION BY key) AS winner FROM sheet),
    won AS (SELECT * FROM first WHERE rank = winner),
    files AS (SELECT 'dir' || p_partkey % 3 || '/' || p_partkey || '/file' || p_partkey % 45 || '.pdf' AS path, 'file' || p_partkey % 45 || '.pdf' AS key, p_partkey FROM part),
    log AS (SELECT path, n AS bookmark_count, CASE WHEN n IS NULL THEN 'SkippedNoRows' WHEN p_partkey % 19 = 0 THEN 'SkippedOpenFile' WHEN p_partkey % 7 = 0 THEN 'SkippedBackupExists'
        WHEN p_partkey % 13 = 0 THEN 'FailedRename' WHEN p_partkey % 11 = 0 THEN 'FailedWrite' WHEN p_partkey % 5 = 0 THEN 'FailedVerify' ELSE 'Success' END AS outcome
        FROM files LEFT JOIN (SELECT key, count(*) AS n FROM won GROUP BY key) USING (key)),
    stats AS (SELECT count(*) AS total, count(*) FILTER (WHERE outcome = 'Success') AS success, count(*) FILTER (WHERE outcome LIKE 'Failed%') AS failed, count(*) FILTER (WHERE outcome LIKE 'Skipped%') AS skipped FROM log)
    """

_FOUND = """WITH hits AS (SELECT conv_id AS doc, turn + 1 AS page, unnest(regexp_extract_all(lower(text), '{0}')) AS hit, generate_subscripts(regexp_extract_all(lower(text), '{0}'), 1) - 1 AS match_no FROM conversations),
    found AS (SELECT doc, page, match_no::BIGINT AS match_no, row_number() OVER (PARTITION BY doc ORDER BY page, match_no) - 1 AS idx FROM hits) """

_CHARS = """WITH listed AS (SELECT doc_id AS doc, regexp_extract_all(coalesce(text, ''), '(?s).') AS l FROM documents),
    chars AS (SELECT doc, len(l) AS n, unnest(l) AS ch, generate_subscripts(l, 1) - 1 AS idx FROM listed),
    placed AS (SELECT *, (idx % 80) * 6.0::DOUBLE AS lft, -12.0::DOUBLE * (idx // 80) AS top FROM chars) """

_LAID = """WITH m AS (SELECT page_id // 10 AS doc, page_id % 10 + 1 AS page, CASE WHEN page_id % 17 <> 0 THEN 1 + (page_id * 7 % 13) / 10.0::DOUBLE ELSE 1.414 END * 600.0::DOUBLE AS height FROM pages),
    tops AS (SELECT *, coalesce(sum(height + 8) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM m),
    laid AS (SELECT *, top + height AS bottom FROM tops),
    views AS (SELECT DISTINCT doc, (doc % 7 * 900)::DOUBLE AS view_top, (doc % 7 * 900 + 700)::DOUBLE AS view_bottom FROM m),
    seen AS (SELECT doc, coalesce(min(page) FILTER (WHERE bottom >= greatest(view_top - 600, 0) AND top <= view_bottom + 600), min(page)) AS first,
        coalesce(max(page) FILTER (WHERE bottom >= greatest(view_top - 600, 0) AND top <= view_bottom + 600), min(page)) AS last FROM laid JOIN views USING (doc) GROUP BY doc) """

_URIS = """WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 2 THEN 'user' || page_id || '@example.org' ELSE 'mailto:a@' || regexp_replace(url, '^[a-z]+://', '') END AS uri FROM pages),
    n AS (SELECT page_id, CASE WHEN contains(uri, '://') OR starts_with(uri, 'mailto:') THEN uri WHEN contains(uri, '@') AND NOT contains(uri, '/') THEN 'mailto:' || uri ELSE 'http://' || uri END AS uri FROM u) """

_DETAIL = f"""CASE outcome WHEN 'Success' THEN '북마크 ' || bookmark_count || '개 저장' WHEN 'SkippedNoRows' THEN '{NO_ROWS.replace("'", "''")}' WHEN 'SkippedBackupExists' THEN '{BACKUP_EXISTS}'
    WHEN 'SkippedOpenFile' THEN '{OPEN_FILE}' WHEN 'FailedRename' THEN '{RENAME_FAILED}' WHEN 'FailedWrite' THEN '{WRITE_FAILED}' ELSE '{VERIFY_FAILED}' END"""


def _fold(kind1: str, action1: str, kind2: str, action2: str, other: str, start: str, step: str, to: str) -> str:
    """Events of each session folded one by one; a session's state after them all."""
    return f"""WITH RECURSIVE e AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE event_type WHEN '{kind1}' THEN '{action1}' WHEN '{kind2}' THEN '{action2}' ELSE '{other}' END AS action, {to} AS to_ FROM events),
        s AS (SELECT DISTINCT session, 0::BIGINT AS k, {start} FROM e UNION ALL SELECT s.session, e.k, {step} FROM s JOIN e ON e.session = s.session AND e.k = s.k + 1),
        last AS (SELECT * FROM s QUALIFY k = max(k) OVER (PARTITION BY session)) """


def oracle_sql() -> dict[str, str]:
    return folders.oracle_sql() | {
        "effective_depth": _tree("SELECT doc, rn, eff, eff < depth AS clamped FROM leveled"),
        "ancestor_path": _tree("SELECT doc, rn, array_to_string(path, '/') AS path FROM tree"),
        "parent_of": _tree("SELECT doc, rn, parent FROM up"),
        "ancestors_of": _tree("SELECT doc, rn, coalesce(array_to_string(list_slice(path, 1, len(path) - 1), '/'), '') AS ancestors FROM tree"),
        "subtree_size": _tree(', x AS (SELECT doc, rn, unnest(path) AS top FROM tree) SELECT doc, top AS rn, max(rn) AS "end", count(*) AS size FROM x GROUP BY doc, top'),
        "find_title": _tree("SELECT doc, title, min(rn) AS rn, arg_min(page, rn) AS page FROM tree GROUP BY doc, title"),
        "flatten_outline": """WITH r AS (SELECT r_regionkey AS k0, -1 AS k1, -1 AS k2, 0 AS depth, r_name AS title FROM region UNION ALL SELECT n_regionkey, n_nationkey, -1, 1, n_name FROM nation
            UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, 2, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
            SELECT 'geo' || k0 AS doc, row_number() OVER (PARTITION BY k0 ORDER BY k1, k2) AS ord, depth::BIGINT AS depth, title, (k1 + 2)::BIGINT AS page FROM r""",
        "import_filter_sort": _tree("""SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY ord, l_partkey, l_suppkey, l_extendedprice) - 1 AS rn, ord, title, page,
            (SELECT count(*) FROM base b WHERE b.doc = base.doc AND b.l_partkey % 3 = 0) AS skipped FROM base WHERE l_partkey % 3 <> 0"""),
        "import_counts": _tree(f"{_FILES} SELECT doc, count(*) FILTER (WHERE own) AS kept, count(*) FILTER (WHERE NOT own) AS skipped FROM named GROUP BY doc"),
        "apply_import": _tree(f"""{_FILES}, mine AS (SELECT doc, depth, title, page, row_number() OVER (PARTITION BY doc ORDER BY ord, l_partkey, l_suppkey, l_extendedprice) - 1 AS rn FROM named WHERE own)
            SELECT doc, rn, rn + least(0, min(depth - rn) OVER (PARTITION BY doc ORDER BY rn ROWS UNBOUNDED PRECEDING)) AS eff, title, page FROM mine
            UNION ALL SELECT doc, rn, eff, title, page FROM tree WHERE doc NOT IN (SELECT doc FROM mine)"""),
        "insert_child": _insert("par", False),
        "insert_by_page_parent": _insert("par", True),
        "insert_by_page_anchor": _insert("NULL::BIGINT", True),
        "remove_subtree": _tree("SELECT t.doc, row_number() OVER (PARTITION BY t.doc ORDER BY rn) - 1 AS rn, eff, title, page FROM tree t LEFT JOIN asked a USING (doc) WHERE a.doc IS NULL OR NOT list_contains(t.path, a.moving)"),
        "move_before": _move("Before"),
        "move_after": _move("After"),
        "move_inside": _move("Inside"),
        "move_rejected": _tree(f"{_FACTS} SELECT doc, moving, target, error FROM checked WHERE error IS NOT NULL"),
        "active_bookmark": _tree("""SELECT e.user_id * 3 + 1 AS doc, e.event_id AS probe, floor(e.value)::BIGINT + 1 AS page, max(t.rn) AS active
            FROM events e LEFT JOIN tree t ON t.doc = e.user_id * 3 + 1 AND t.page <= floor(e.value)::BIGINT + 1 GROUP BY ALL"""),
        "next_selection": _tree("SELECT doc, rn, coalesce(lead(rn) OVER w, lag(rn) OVER w, parent) AS selected FROM up WINDOW w AS (PARTITION BY doc, parent ORDER BY rn)"),
        "visible_outline": _tree(f"{_SEEN} SELECT doc, rn, title FROM seen"),
        "visible_neighbours": _tree(f"{_SEEN} SELECT doc, rn, lag(rn) OVER w AS above, lead(rn) OVER w AS below FROM seen WINDOW w AS (PARTITION BY doc ORDER BY rn)"),
        "fold_target": _tree(", k AS (SELECT *, coalesce(lead(eff) OVER (PARTITION BY doc ORDER BY rn) > eff, false) AS has_children FROM up) SELECT doc, rn, has_children, CASE WHEN has_children THEN rn ELSE parent END AS fold FROM k"),
        "drop_position": "WITH r AS (SELECT conv_id, turn, (conv_id * 7 + turn) % 100 / 100.0::DOUBLE AS ratio FROM conversations) SELECT conv_id, turn, CASE WHEN ratio < 0.25 THEN 'Before' WHEN ratio > 0.75 THEN 'After' ELSE 'Inside' END AS position FROM r",
        "rename_blanks": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS title, doc_id AS page FROM documents",
        "page_texts": """WITH l AS (SELECT conv_id AS doc, turn + 1 AS page, regexp_extract_all(text, '(?s).') AS l FROM conversations),
            c AS (SELECT doc, page, unnest(l) AS ch, generate_subscripts(l, 1) - 1 AS idx FROM l)
            SELECT doc, page, string_agg(CASE WHEN idx > 0 AND idx % 20 = 0 THEN chr(10) ELSE '' END || ch, '' ORDER BY idx) AS text FROM c GROUP BY doc, page""",
        "rename_commit": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS title FROM documents",
        "write_page_fallback": _tree(""", pg AS (SELECT s_suppkey % 5 AS doc, s_suppkey AS page FROM supplier WHERE s_suppkey % 3 <> 0)
            SELECT t.doc AS outline, t.rn, t.page, coalesce(pg.page, (SELECT min(page) FROM pg f WHERE f.doc = t.doc % 6), 0) AS target FROM tree t LEFT JOIN pg ON pg.doc = t.doc % 6 AND pg.page = t.page"""),
        "source_rank": _BATCH + "SELECT path, rank FROM src",
        "first_source_wins": _BATCH + "SELECT key, row_number() OVER (PARTITION BY key ORDER BY ord, rank, src_row) - 1 AS rn, ord, title, winner FROM won",
        "duplicate_notes": _BATCH + """, lost AS (SELECT key, rank, winner, count(*) AS n FROM first WHERE rank > winner GROUP BY ALL)
            SELECT lost.rank, key, n, '[중복] ''' || s.path || '''의 ''' || key || ''' 행 ' || n || '개 건너뜀 — 먼저 읽은 ''' || w.path || '''의 행을 적용' AS note FROM lost JOIN src s ON s.rank = lost.rank JOIN src w ON w.rank = lost.winner""",
        "matched_files": _BATCH + "SELECT count(*) AS matched FROM files WHERE key IN (SELECT key FROM sheet)",
        "batch_outcome": _BATCH + "SELECT path, outcome, bookmark_count FROM log",
        "batch_stats": _BATCH + "SELECT *, '전체 ' || total || '개 중 ' || success || '개 성공, ' || failed || '개 실패, ' || skipped || '개 건너뜀' AS line FROM stats",
        "batch_log": _BATCH + f"SELECT path, '[' || CASE WHEN outcome = 'Success' THEN '성공' WHEN outcome LIKE 'Failed%' THEN '실패' ELSE '건너뜀' END || '] ' || path || ' — ' || {_DETAIL} AS line FROM log",
        "batch_log_file": _BATCH + f""", lost AS (SELECT key, rank, winner, count(*) AS n FROM first WHERE rank > winner GROUP BY ALL)
            SELECT 0 AS section, unnest([0, 1, 2]) AS rank, '' AS name, unnest(['{LOG_TITLE}', '{LOG_TIME}2026-01-02 03:04:05', '{LOG_FOLDER}/batch']) AS line
            UNION ALL SELECT 1, rank, '', '{LOG_SHEET}' || path FROM src
            UNION ALL SELECT 2, lost.rank, key, '[중복] ''' || s.path || '''의 ''' || key || ''' 행 ' || n || '개 건너뜀 — 먼저 읽은 ''' || w.path || '''의 행을 적용' FROM lost JOIN src s ON s.rank = lost.rank JOIN src w ON w.rank = lost.winner
            UNION ALL SELECT unnest([3, 5]), 0, '', '{LOG_RULE}'
            UNION ALL SELECT 4, 0, replace(path, '/', chr(1)), '[' || CASE WHEN outcome = 'Success' THEN '성공' WHEN outcome LIKE 'Failed%' THEN '실패' ELSE '건너뜀' END || '] ' || path || ' — ' || {_DETAIL} FROM log
            UNION ALL SELECT 6, 0, '', '전체 ' || total || '개 중 ' || success || '개 성공, ' || failed || '개 실패, ' || skipped || '개 건너뜀' FROM stats""",
        "nfc_match": "SELECT c_custkey, nfc_normalize('cafe' || chr(769) || ' ' || chr(4370) || chr(4449) || chr(4523) || chr(4352) || chr(4467) || chr(4527) || ' ' || c_custkey % 10) = 'caf' || chr(233) || ' ' || chr(54620) || chr(44544) || ' ' || c_nationkey % 10 AS matched, false AS raw_matched FROM customer",
        "page_search": _FOUND.format("the") + "SELECT * FROM found",
        "search_start": _FOUND.format("an") + "SELECT doc, coalesce(min(idx) FILTER (WHERE page >= doc % 5 + 1), 0) AS start FROM found GROUP BY doc",
        "search_cycle": _FOUND.format("an") + ", n AS (SELECT *, count(*) OVER (PARTITION BY doc) AS n FROM found) SELECT doc, idx, (idx + 1) % n AS next, (idx + n - 1) % n AS previous, CASE WHEN idx = 0 THEN 'primary' ELSE 'secondary' END AS class FROM n",
        "range_extract": _CHARS + """, r AS (SELECT doc, n, idx, ch, least(doc * 7919 % n, doc * 104729 % n) AS a, greatest(doc * 7919 % n, doc * 104729 % n) AS b FROM chars)
            SELECT doc, string_agg(CASE WHEN idx > a AND idx % 80 = 0 THEN chr(10) ELSE '' END || ch, '' ORDER BY idx) AS text FROM r WHERE idx BETWEEN a AND b GROUP BY doc""",
        "line_breaks": _CHARS + """, b AS (SELECT doc, idx, ch, coalesce(abs(top - lag(top) OVER w) > 15 OR abs(lft - lag(lft) OVER w) > 60, false) AS breaks FROM placed WINDOW w AS (PARTITION BY doc ORDER BY idx)),
            t AS (SELECT doc, string_agg(CASE WHEN breaks THEN chr(10) ELSE '' END || ch, '' ORDER BY idx) AS text FROM b GROUP BY doc) SELECT doc, md5(text) AS text_md5, length(text) AS n_chars FROM t""",
        "char_quads": _CHARS + "SELECT doc, idx, lft AS x0, top AS y0, lft + 6 AS x2, top - 10 AS y2, 0.0::DOUBLE AS rotation FROM placed",
        "selection_quads": _CHARS + "SELECT doc, idx, lft AS x0, top AS y0, lft + 6 AS x2, top - 10 AS y2, 0.0::DOUBLE AS rotation FROM placed WHERE idx BETWEEN least(doc * 7919 % n, doc * 104729 % n) AND greatest(doc * 7919 % n, doc * 104729 % n)",
        "char_hit": _CHARS + """, p AS (SELECT doc_id AS doc, (doc_id * 13) % 500 + 0.25::DOUBLE AS x, -1.0::DOUBLE * ((doc_id * 7919) % (12 * ((length(text) + 79) // 80))) - 0.5 AS y FROM documents WHERE length(text) > 0),
            d AS (SELECT doc, idx, greatest(lft - x, x - lft - 6, 0) AS dx, greatest(top - 10 - y, y - top, 0) AS dy FROM placed JOIN p USING (doc))
            SELECT doc, doc AS probe, arg_min(idx, (dx * dx + dy * dy, idx)) AS idx FROM d WHERE dx <= 6 AND dy <= 6 GROUP BY doc""",
        "normalize_uri": _URIS + "SELECT page_id, uri FROM n",
        "link_target": _URIS + "SELECT page_id, CASE WHEN page_id % 5 IN (0, 3) THEN 'Page' WHEN page_id % 5 = 1 THEN 'Uri' END AS kind, CASE page_id % 5 WHEN 0 THEN page_id % 90 + 1 WHEN 3 THEN page_id % 70 + 1 END AS page, CASE WHEN page_id % 5 = 1 THEN uri END AS uri FROM n",
        "link_at_point": _URIS + """, l AS (SELECT page_id, uri, unnest([0, 1, 2, 3, 4]) AS link_no FROM n),
            q AS (SELECT page_id, probe, (page_id * 13 + probe * 31) % 150 AS x, (page_id * 7 + probe * 17) % 80 AS y FROM (SELECT page_id, unnest([0, 1, 2]) AS probe FROM pages)),
            hit AS (SELECT page_id, probe, max(link_no) AS link_no FROM l JOIN q USING (page_id) WHERE x BETWEEN page_id % 7 + 20 * link_no AND page_id % 7 + 20 * link_no + 30 AND y BETWEEN 10 * link_no AND 10 * link_no + 25 GROUP BY ALL)
            SELECT page_id, probe, link_no, CASE (page_id + link_no) % 4 WHEN 0 THEN 'Page' WHEN 1 THEN 'Uri' WHEN 3 THEN 'Page' END AS kind,
                CASE (page_id + link_no) % 4 WHEN 0 THEN page_id % 90 + link_no + 1 WHEN 3 THEN page_id % 70 + link_no + 1 END AS target, CASE WHEN (page_id + link_no) % 4 = 1 THEN uri END AS uri FROM hit JOIN l USING (page_id, link_no)""",
        "export_name": """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'bookmarks.xlsx' ELSE 'bookmark-' || regexp_replace(p_name, '[^a-z0-9]', '_', 'g') || '.v2.xlsx' END AS name,
            CASE WHEN p_size % 3 = 0 THEN p_size::BIGINT WHEN p_size % 3 = 2 AND p_size::BIGINT * 1000000000 <= 4294967295 THEN p_size::BIGINT * 1000000000 END AS page FROM part""",
        "page_layout": _LAID + "SELECT doc, page, round(height, 4) AS height, round(top, 4) AS top, round(bottom, 4) AS bottom FROM laid",
        "page_at_y": _LAID + "SELECT doc, doc * 37 % 700 - 20.0::DOUBLE AS x, view_top + 3 AS y, min(page) FILTER (WHERE top <= view_top + 3 AND view_top + 3 <= bottom AND doc * 37 % 700 - 20 BETWEEN 0 AND 600) AS page FROM laid JOIN views USING (doc) GROUP BY ALL",
        "visible_pages": _LAID + "SELECT * FROM seen",
        "views_tracked": _LAID + """, two AS (SELECT doc, 0 AS view, view_top, view_bottom FROM views UNION ALL SELECT doc, 1, view_top + 4000, view_bottom + 4000 FROM views),
            many AS (SELECT doc, view, coalesce(min(page) FILTER (WHERE bottom >= greatest(view_top - 600, 0) AND top <= view_bottom + 600), min(page)) AS first,
                coalesce(max(page) FILTER (WHERE bottom >= greatest(view_top - 600, 0) AND top <= view_bottom + 600), min(page)) AS last FROM laid JOIN two USING (doc) GROUP BY doc, view)
            SELECT doc, view, first, last, arg_min(page, (abs(top + height / 2 - (view_top + view_bottom) / 2), page)) AS page FROM laid JOIN two USING (doc) JOIN many USING (doc, view) WHERE page BETWEEN first AND last GROUP BY ALL""",
        "tracked_page": _LAID + "SELECT doc, arg_min(page, (abs(top + height / 2 - (view_top + view_bottom) / 2), page)) AS page FROM laid JOIN views USING (doc) JOIN seen USING (doc) WHERE page BETWEEN first AND last GROUP BY doc",
        "render_width": """WITH p AS (SELECT p_partkey, (p_partkey * 37 % 900)::DOUBLE AS w, (p_partkey * 53 % 1200 + 1)::DOUBLE AS h, (p_partkey * 91 % 40000)::DOUBLE AS t FROM part),
            a AS (SELECT *, CASE WHEN w > 0 THEN h / w ELSE 1.0 END AS aspect FROM p)
            SELECT p_partkey, greatest(floor(least(CASE WHEN t * aspect > 16384 THEN 16384 / aspect ELSE t END, 16384)), 50)::BIGINT AS width, round(h / greatest(w, 1.0), 6) AS aspect FROM a""",
        "zoom_fit": """WITH p AS (SELECT p_partkey, p_size, p_size / 20.0::DOUBLE AS ratio, (p_partkey % 1500 + 1)::DOUBLE AS panel FROM part)
            SELECT p_partkey, round(greatest(0.25, least(900 / greatest(panel * ratio, 1.0), 8.0)), 6) AS fit, round(greatest(CASE WHEN ratio > 1 THEN 16384 / ratio ELSE 16384 END / greatest(panel * 2, 1.0), 0.25), 6) AS ceiling,
            greatest(round(panel * 1.25 * 2), 50)::BIGINT AS width, round(greatest(0.25, least(ratio * (1 + p_size * 10 * 0.001), 8.0)), 6) AS wheel,
            round(greatest(-greatest((panel - 700) / 2, 0), least(p_size * 10.0::DOUBLE, greatest((panel - 700) / 2, 0))), 6) + 0.0 AS pan FROM p""",
        "page_clamp": "SELECT o_orderkey, greatest(1, least(o_custkey % 40 - 5, greatest(o_orderkey % 25, 1))) AS page FROM orders",
        "page_history": _fold("error", "back", "signup", "forward", "go", "1::BIGINT AS page, []::BIGINT[] AS back, []::BIGINT[] AS forward", """
            CASE WHEN action = 'go' THEN to_ WHEN action = 'back' AND len(back) > 0 THEN back[-1] WHEN action = 'forward' AND len(forward) > 0 THEN forward[-1] ELSE page END,
            CASE WHEN (action = 'go' AND to_ <> page) OR (action = 'forward' AND len(forward) > 0) THEN list_append(back, page) WHEN action = 'back' AND len(back) > 0 THEN back[:-2] ELSE back END,
            CASE WHEN action = 'go' AND to_ <> page THEN [] WHEN action = 'back' AND len(back) > 0 THEN list_append(forward, page) WHEN action = 'forward' AND len(forward) > 0 THEN forward[:-2] ELSE forward END""",
            "greatest(1, least(floor(value)::BIGINT + 1, 90))") + "SELECT session, page, array_to_string(back, ',') AS back, array_to_string(forward, ',') AS forward FROM last",
        "undo_redo": _fold("error", "undo", "signup", "redo", "edit", "0::BIGINT AS now, []::BIGINT[] AS undo, []::BIGINT[] AS redo", """
            CASE WHEN action = 'edit' THEN to_ WHEN action = 'undo' AND len(undo) > 0 THEN undo[-1] WHEN action = 'redo' AND len(redo) > 0 THEN redo[-1] ELSE now END,
            CASE WHEN action = 'edit' THEN list_append(undo, now)[-20:] WHEN action = 'undo' AND len(undo) > 0 THEN undo[:-2] WHEN action = 'redo' AND len(redo) > 0 THEN list_append(undo, now) ELSE undo END,
            CASE WHEN action = 'edit' THEN [] WHEN action = 'undo' AND len(undo) > 0 THEN list_append(redo, now)[-20:] WHEN action = 'redo' AND len(redo) > 0 THEN redo[:-2] ELSE redo END""",
            "floor(value)::BIGINT + 1") + "SELECT session, now AS current, len(undo) AS undo, len(redo) AS redo FROM last",
        "recent_files": """WITH l AS (SELECT user_id AS session, 'doc' || (floor(value)::BIGINT + 1) % 20 AS path, max(ts) AS ts FROM events GROUP BY ALL),
            r AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY ts DESC, path) AS place, path FROM l) SELECT * FROM r WHERE place <= 10""",
        "crash_sessions": "SELECT user_id AS session, max(ts) AS saved_at FROM events GROUP BY user_id HAVING arg_max(event_type, ts) <> 'purchase'",
        "csv_roundtrip": _ROUND,
        "xlsx_roundtrip": _ROUND,
        "legacy_csv": "SELECT * FROM (VALUES (1::BIGINT, '문서.pdf', 0::BIGINT, '서론', 1::BIGINT), (2, '문서.pdf', 1, '본론', 5)) AS t(ord, filename, depth, title, page)",
        "autosave_recover": """WITH e AS (SELECT user_id AS session, ts, event_type, floor(value)::BIGINT + 1 AS page FROM events),
            l AS (SELECT session, arg_max(event_type, ts) AS kind, arg_max(page, ts) AS page FROM e WHERE page % 3 <> 0 GROUP BY session) SELECT session, 'f' || page AS file_path, '[]' AS bookmarks FROM l WHERE kind <> 'purchase'""",
    }


_ROUND = """SELECT n_nationkey::BIGINT + 1 AS ord, '문서, "가".pdf' AS filename, n_nationkey::BIGINT % 3 AS depth, '제목 ' || n_name AS title, n_regionkey::BIGINT + 1 AS page FROM nation"""
