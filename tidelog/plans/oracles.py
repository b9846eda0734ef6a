"""The named queries in DuckDB's SQL."""

from __future__ import annotations

OBS = """obs AS (SELECT event_id AS id, user_id AS rpid, 'v' || (user_id % 15) AS bvid, user_id % 40 AS author_mid, ts AS captured_at, epoch_us(ts) AS us, event_type || ' ' || props AS content, CAST(floor(value) AS BIGINT) AS like_count,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS reply_count, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 20 + 1 AS position, CASE WHEN event_type IN ('view', 'click') THEN 'hot' ELSE 'latest' END AS sort_mode,
  CASE WHEN event_type = 'error' THEN 'folded' ELSE 'visible' END AS visibility, event_id AS raw_payload_id, event_type, CASE WHEN user_id % 4 = 0 THEN user_id - 1 END AS root_rpid FROM events)"""
METRICS = """metrics AS (SELECT 'v' || (user_id % 15) AS bvid, ts AS captured_at, epoch_us(ts) AS us, CAST(floor(value * 100) AS BIGINT) AS view_count, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS like_count,
  CASE WHEN event_type <> 'error' THEN event_id % 7 END AS coin_count, user_id AS owner_mid, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'visible' END AS status, event_id AS raw_payload_id FROM events)"""
VIDEOS = "videos AS (SELECT 'v' || n AS bvid, n % 5 <> 0 AS active, CASE WHEN n % 2 = 0 THEN 'seed' ELSE 'keyword' END AS association_reason, CAST(n % 4 / 4 AS DOUBLE) AS confidence, 1704067200000000 + n * 3600000000 AS first_seen_at FROM range(15) t(n))"
SCOPED = f"{OBS}, {VIDEOS}, scoped AS (SELECT * FROM obs WHERE bvid IN (SELECT bvid FROM videos WHERE active) AND captured_at >= TIMESTAMP '2024-01-01' AND captured_at < TIMESTAMP '2024-02-01')"
WORDS = "words AS (SELECT unnest(['click', 'error', 'purchase']) AS keyword)"
HITS = f"{SCOPED}, {WORDS}, hits AS (SELECT keyword, rpid, id, raw_payload_id, us // 1000000 AS s FROM scoped, words WHERE contains(lower(content), keyword))"


def grid(step: int) -> str:
    return f"grid AS (SELECT CAST(n AS BIGINT) AS bucket FROM range(1704067200, 1706745600, {step}) t(n))"


TREND = f"{HITS}, {grid(86400)}, counts AS (SELECT keyword, s // 86400 * 86400 AS bucket, count(DISTINCT rpid) AS d, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM hits GROUP BY ALL)"
PAGES = f"{OBS}, hot AS (SELECT *, us // 86400000000 AS day, bvid || '-' || (us // 86400000000) AS page_id FROM obs WHERE sort_mode = 'hot'), on_page AS (SELECT page_id, bvid, day, rpid, id, row_number() OVER (PARTITION BY page_id ORDER BY like_count DESC, id) AS place FROM hot)"
TURNOVER = f"""{PAGES}, top AS (SELECT page_id, bvid, day, rpid, min(place) AS place FROM on_page WHERE place <= 5 GROUP BY ALL), lists AS (SELECT page_id, bvid, day, list(rpid ORDER BY place) AS now FROM top GROUP BY ALL),
 pairs AS (SELECT *, lag(now) OVER w AS was, lag(page_id) OVER w AS previous_page_id FROM lists WINDOW w AS (PARTITION BY bvid ORDER BY day, page_id)),
 turnover AS (SELECT bvid, previous_page_id, page_id AS current_page_id, day * 86400000000 AS captured_at, len(list_intersect(was, now)) AS retained, list_sort(list_filter(now, lambda x: NOT list_contains(was, x))) AS entered, list_sort(list_filter(was, lambda x: NOT list_contains(now, x))) AS exited,
   1 - len(list_intersect(was, now)) / greatest(len(was), len(now), 1) AS rate FROM pairs WHERE was IS NOT NULL)"""
DOCS = "docs AS (SELECT doc_id AS id, doc_id AS rpid, source AS bvid, doc_id % 5 AS author_mid, 1704067200 + 30 * doc_id AS s, text, replace(lower(text), 'ß', 'ss') AS folded FROM documents)"
ALNUM = DOCS + ", f AS (SELECT *, regexp_replace(folded, '[^\\p{L}\\p{N}]', '', 'g') AS key FROM docs)"
SAME = f"{ALNUM}, same AS (SELECT a.author_mid, a.rpid AS subject_rpid, b.rpid AS related_rpid FROM f a JOIN f b ON a.author_mid = b.author_mid AND a.key = b.key AND a.rpid < b.rpid WHERE a.key <> '')"
TALK = "talk AS (SELECT conv_id * 1000 + turn AS rpid, 'v' || (conv_id % 15) AS bvid, CASE WHEN turn > 0 THEN conv_id * 1000 END AS root_rpid, 1704067200 + conv_id * 60 + turn AS s, conv_id, turn, role, text FROM conversations WHERE turn IS NOT NULL)"
COVERAGE = """cover AS (SELECT l_suppkey AS target_id, CAST(o_orderdate AS DATE) AS started_at, CAST(l_shipdate AS DATE) AS finished_at, o_orderpriority AS task_kind, CASE l_returnflag WHEN 'N' THEN 'succeeded' WHEN 'R' THEN 'partial' ELSE 'failed' END AS status,
  CAST(floor(l_quantity) AS BIGINT) AS pages_requested, CAST(floor(l_quantity * (1 - l_discount)) AS BIGINT) AS pages_succeeded, CAST(l_linenumber AS BIGINT) AS request_errors, l_linestatus = 'O' AS truncated, l_partkey % 30 AS items_observed, CAST(l_linenumber AS BIGINT) AS raw_payloads_saved, l_suppkey % 3 AS parse_errors, l_partkey % 17 = 0 AS corrupted FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
MEDIA = "media AS (SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS position, l_partkey % 50 AS media_source_id, o_custkey AS rpid, CAST(l_shipdate AS DATE) AS arrived FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
CHANGES = f"""{OBS}, p AS (SELECT *, sha256(trim(content)) AS h, CASE WHEN like_count IS NULL THEN 'unknown' WHEN like_count < 10 THEN '0-9' WHEN like_count < 100 THEN '10-99' WHEN like_count < 1000 THEN '100-999' WHEN like_count < 10000 THEN '1k-9999' WHEN like_count < 100000 THEN '10k-99999' ELSE '100k+' END AS likes FROM obs),
 q AS (SELECT *, lag(id) OVER w AS pid, lag(h) OVER w AS ph, lag(likes) OVER w AS pl, lag(reply_count) OVER w AS pr, lag(sort_mode) OVER w AS pm, lag(position) OVER w AS pp FROM p WINDOW w AS (PARTITION BY rpid ORDER BY us, id)),
 changes AS (SELECT rpid, bvid, pid AS previous_id, id AS current_id, 'first_seen' AS event_type, CAST(NULL AS VARCHAR) AS old_value, CAST(NULL AS VARCHAR) AS new_value, us AS created_at FROM q WHERE pid IS NULL
  UNION ALL SELECT rpid, bvid, pid, id, 'content_hash_changed', ph, h, us FROM q WHERE pid IS NOT NULL AND ph IS DISTINCT FROM h
  UNION ALL SELECT rpid, bvid, pid, id, 'like_bucket_changed', pl, likes, us FROM q WHERE pid IS NOT NULL AND pl IS DISTINCT FROM likes
  UNION ALL SELECT rpid, bvid, pid, id, 'reply_count_changed', CAST(pr AS VARCHAR), CAST(reply_count AS VARCHAR), us FROM q WHERE pid IS NOT NULL AND pr IS DISTINCT FROM reply_count
  UNION ALL SELECT rpid, bvid, pid, id, 'hot_position_changed', CAST(pp AS VARCHAR), CAST(position AS VARCHAR), us FROM q WHERE pm = 'hot' AND sort_mode = 'hot' AND pp IS DISTINCT FROM position)"""
SEEN = f"""{OBS}, rows AS (SELECT *, event_type <> 'signup' AS seen FROM obs),
 r AS (SELECT *, lag(seen) OVER w AS was_seen, last_value(CASE WHEN seen THEN id END IGNORE NULLS) OVER v AS last_id, last_value(CASE WHEN seen THEN visibility END IGNORE NULLS) OVER v AS last_vis FROM rows
   WINDOW w AS (PARTITION BY rpid ORDER BY us, id), v AS (PARTITION BY rpid ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 vis AS (SELECT rpid, bvid, last_id AS previous_id, CAST(NULL AS BIGINT) AS current_id, 'disappeared' AS event_type, coalesce(last_vis, 'visible') AS old_visibility, 'missing' AS new_visibility, us AS created_at FROM r WHERE NOT seen AND coalesce(was_seen, true)
  UNION ALL SELECT rpid, bvid, last_id, id, 'reappeared', 'missing', visibility, us FROM r WHERE seen AND NOT coalesce(was_seen, true)
  UNION ALL SELECT rpid, bvid, last_id, id, 'folded', last_vis, visibility, us FROM r WHERE seen AND last_vis = 'visible' AND visibility = 'folded'
  UNION ALL SELECT rpid, bvid, last_id, id, 'unfolded', last_vis, visibility, us FROM r WHERE seen AND last_vis = 'folded' AND visibility = 'visible')"""


def comment_spikes(filtered: str = "true") -> str:
    """Spikes of comments first seen on active videos, of those whose first content passes."""
    return f"""first_seen AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY rpid ORDER BY us, id) = 1), own AS (SELECT * FROM first_seen WHERE bvid IN (SELECT bvid FROM videos WHERE active) AND {filtered}),
 n AS (SELECT us // 3600000000 * 3600 AS bucket, count(*) AS n FROM own WHERE captured_at >= TIMESTAMP '2024-01-01' AND captured_at < TIMESTAMP '2024-02-01' GROUP BY ALL),
 s AS (SELECT bucket, coalesce(n, 0) AS n, lag(coalesce(n, 0)) OVER (ORDER BY bucket) AS was FROM grid LEFT JOIN n USING (bucket)),
 spikes AS (SELECT 'comment_spike' AS signal_type, bucket, 'event' AS scope_type, 'event' AS scope, round(n / greatest(was, 1), 6) AS magnitude, was AS previous_count, n AS current_count FROM s WHERE was IS NOT NULL AND n >= 1 AND n >= greatest(1, was * 1.2))"""


K_SPIKE = f"""{HITS}, {grid(3600)}, kc AS (SELECT keyword, s // 3600 * 3600 AS bucket, count(DISTINCT rpid) AS n FROM hits GROUP BY ALL),
 ks AS (SELECT keyword, bucket, coalesce(n, 0) AS n, lag(coalesce(n, 0)) OVER (PARTITION BY keyword ORDER BY bucket) AS was FROM grid CROSS JOIN words LEFT JOIN kc USING (keyword, bucket)),
 kspikes AS (SELECT 'keyword_spike' AS signal_type, bucket, 'keyword' AS scope_type, keyword AS scope, round(n / greatest(was, 1), 6) AS magnitude, was AS previous_count, n AS current_count FROM ks WHERE was IS NOT NULL AND n >= 3 AND n >= greatest(3, was * 1.5))"""
C_SPIKE = f"{OBS}, {VIDEOS}, {grid(3600)}, {comment_spikes()}"
T_SIGNAL = "'hot_turnover' AS signal_type, captured_at // 1000000 AS bucket, 'video' AS scope_type, bvid AS scope, round(rate, 6) AS magnitude, CAST(NULL AS BIGINT) AS previous_count, CAST(NULL AS BIGINT) AS current_count FROM turnover WHERE rate >= 0.9"
CREATOR = f"{METRICS}, {VIDEOS}, creators AS (SELECT 'major_creator_involvement' AS signal_type, min(us) // 1000000 AS bucket, 'video' AS scope_type, bvid AS scope, 1.0::DOUBLE AS magnitude, CAST(NULL AS BIGINT) AS previous_count, CAST(NULL AS BIGINT) AS current_count FROM metrics WHERE owner_mid = 3 AND bvid IN (SELECT bvid FROM videos WHERE active) AND captured_at < TIMESTAMP '2024-02-01' GROUP BY bvid HAVING min(captured_at) >= TIMESTAMP '2024-01-01')"
BIT = "CASE WHEN e[i + 1] >= 0 THEN (CASE WHEN i = 63 THEN -9223372036854775808 ELSE (1::HUGEINT << i) END) ELSE 0 END"
SIGNS = f"""base AS (SELECT vec_id AS id, CAST(list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] >= 0 THEN (CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE pow(2, i)::HUGEINT END) ELSE 0::HUGEINT END)) AS BIGINT) AS s FROM embeddings),
 sig AS (SELECT id, s FROM base UNION ALL SELECT id + 100000, xor(s, CAST(pow(2, id % 7) AS BIGINT) - 1) FROM base UNION ALL SELECT id + 200000, xor(s, CAST(pow(2, 2 * (id % 7)) AS BIGINT) - 1) FROM base),
 edges AS (SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.s, b.s)) AS BIGINT) AS distance FROM sig a JOIN sig b ON a.id < b.id WHERE bit_count(xor(a.s, b.s)) <= 5)"""


def closure(edges: str, a: str, b: str) -> str:
    """node and its least reachable node, of the nodes with edges."""
    return f"both_ways AS (SELECT {a} AS x, {b} AS y FROM {edges} UNION SELECT {b}, {a} FROM {edges}), reach(node, label) AS (SELECT x, x FROM both_ways UNION SELECT y, label FROM reach JOIN both_ways ON node = x), parts AS (SELECT node, min(label) AS cluster FROM reach GROUP BY node)"


NOW = 1705752000
GROWTH = f"""g AS (SELECT bvid, arg_max(view_count, us) AS last, max(us) AS last_at, arg_max(view_count, us) FILTER (us <= {NOW - 172800}000000) AS base, max(us) FILTER (us <= {NOW - 172800}000000) AS base_at,
  arg_min(view_count, us) FILTER (us > {NOW - 172800}000000) AS first, min(us) FILTER (us > {NOW - 172800}000000) AS first_at FROM metrics WHERE us <= {NOW}000000 AND view_count IS NOT NULL GROUP BY bvid),
 growth AS (SELECT bvid, CASE WHEN coalesce(base_at, first_at) <> last_at THEN greatest(last - coalesce(base, first), 0) END AS view_growth FROM g)"""
ASSESSED = f"""{METRICS}, {GROWTH}, seen_first AS (SELECT bvid, min(us) AS first_us FROM metrics GROUP BY bvid),
 a AS (SELECT f.bvid, first_us, first_us // 1000000 AS anchor, {NOW} - first_us // 1000000 AS age, view_growth AS v, CAST(substring(f.bvid, 2) AS BIGINT) AS n FROM seen_first f LEFT JOIN growth USING (bvid)),
 tiered AS (SELECT *, CASE WHEN n = 3 AND age >= 0 AND age < 21600 THEN 's' WHEN n = 7 THEN 's' WHEN n = 9 THEN 'b' WHEN v >= 6000 OR n * 4 >= 60 OR (n % 2 = 0 AND n / 40 >= 0.35) THEN 's' WHEN v >= 1200 OR n * 4 >= 20 OR (n % 2 = 0 AND n / 40 >= 0.2) THEN 'a' WHEN v >= 300 OR n * 4 >= 5 THEN 'b' ELSE 'c' END AS desired FROM a)"""
RANK = "(CASE {0} WHEN 's' THEN 1 WHEN 'a' THEN 2 WHEN 'b' THEN 3 ELSE 4 END)"
AGE_STEP = "CASE WHEN {age} < 1800 THEN 60 WHEN {age} < 21600 THEN 300 WHEN coalesce(v, 0) > 30000 THEN 300 WHEN coalesce(v, 0) > 6000 THEN 900 WHEN coalesce(v, 0) > 1200 THEN 1800 ELSE 7200 END"
SLOTS = f"""{ASSESSED}, slots AS (SELECT bvid, {NOW} - n * 7200 AS anchor, {NOW} - n * 3600 AS discovered, CAST(h AS BIGINT) AS hours, {NOW} - n * 7200 + h * 3600 AS due FROM a CROSS JOIN (SELECT unnest([6, 12, 18, 24]) AS h)),
 states AS (SELECT *, CASE WHEN discovered > due + 3600 THEN 'not_applicable' WHEN {NOW} <= due + 3600 THEN 'planned' ELSE 'missed' END AS state FROM slots)"""
EXACT = f"{ALNUM}, pairs AS (SELECT a.rpid AS left_rpid, b.rpid AS right_rpid, a.bvid AS left_bvid, b.bvid AS right_bvid, 1.0::DOUBLE AS similarity, b.s - a.s AS seconds_apart, 'normalized_exact_text_cross_video' AS algorithm FROM f a JOIN f b ON a.key = b.key AND a.rpid < b.rpid AND a.bvid <> b.bvid AND b.s - a.s <= 86400 WHERE length(a.key) >= 4)"
LEX = "lex AS (SELECT * FROM (VALUES ('support', 'the'), ('support', 'und'), ('support', 'que'), ('criticism', 'idiot'), ('criticism', 'trash'), ('neutral', 'for'), ('neutral', 'de la')) t(category, term))"

SIGHT = "sight AS (SELECT 'v' || o_custkey AS bvid, o_orderkey AS k, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS us, o_orderpriority AS pool_type, o_orderstatus AS pool_id FROM orders)"

RECORDS = "records AS (SELECT doc_id AS rpid, source AS bvid, doc_id % 5 AS author_mid, 'n' || (doc_id % 5) AS author_name, coalesce(text, '') AS content, (1704067200 + 30 * doc_id) * 1000000 AS first_seen_at, CASE WHEN doc_id % 4 <> 3 THEN doc_id // 3 END AS raw_payload_id FROM documents)"
CLUSTERED = f"""{EXACT}, {RECORDS}, {closure('pairs', 'left_rpid', 'right_rpid')}, firsts AS (SELECT cluster, row_number() OVER (ORDER BY min(left_rpid * 10000000 + right_rpid)) AS cluster_id FROM pairs JOIN parts ON node = left_rpid GROUP BY cluster),
  edges AS (SELECT cluster_id, pairs.* FROM pairs JOIN parts ON node = left_rpid JOIN firsts USING (cluster)), members AS (SELECT cluster_id, left_rpid AS rpid FROM edges UNION SELECT cluster_id, right_rpid FROM edges)"""

LOG = """log AS (SELECT epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS ts, o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN 'set_active' WHEN 1 THEN 'attach' ELSE 'add' END AS op, o_custkey % 5 AS event_id, ['uid', 'keyword', 'seed_bvid'][o_orderkey % 3 + 1] AS target_type,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Word ' ELSE 'v' END || (o_custkey % 40) AS target_value, lower(CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Word ' ELSE 'v' END || (o_custkey % 40)) AS normalized_value, o_orderkey % 11 AS priority, o_custkey % 2 = 0 AS active, o_orderpriority, 'v' || (o_custkey % 40) AS bvid, 'by ' || o_orderstatus AS reason, o_orderkey % 4 / 4 AS confidence FROM orders),
 adds AS (SELECT * FROM log WHERE op = 'add'), firsts AS (SELECT event_id, target_type, normalized_value, arg_min(k, (ts, k)) AS target_id, min((ts, k)) AS since FROM adds GROUP BY ALL),
 entries AS (SELECT event_id, target_type, normalized_value, name, arg_max(value, (ts, k)) AS value FROM (SELECT *, 'k' || (k % 4) AS name, o_orderpriority AS value FROM adds UNION ALL SELECT *, 'last', CAST(k AS VARCHAR) FROM adds) GROUP BY ALL),
 extras AS (SELECT event_id, target_type, normalized_value, string_agg(name || '=' || value, ',' ORDER BY name) AS extra FROM entries GROUP BY ALL),
 states AS (SELECT event_id, target_type, normalized_value, arg_max(CASE WHEN op = 'add' THEN true ELSE active END, (ts, k)) AS active, max(ts) AS updated_at FROM log WHERE op <> 'attach' GROUP BY ALL),
 shown AS (SELECT event_id, target_type, normalized_value, arg_max(target_value, (ts, k)) AS target_value, max(priority) AS priority, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM adds GROUP BY ALL),
 targets AS (SELECT target_id, event_id, target_type, normalized_value, target_value, priority, active, extra, first_seen_at, last_seen_at, updated_at FROM firsts JOIN extras USING (event_id, target_type, normalized_value) JOIN states USING (event_id, target_type, normalized_value) JOIN shown USING (event_id, target_type, normalized_value))"""

TIERED = f"""RECURSIVE {OBS}, a AS (SELECT bvid, row_number() OVER (PARTITION BY bvid ORDER BY captured_at, id) AS k, reply_count % 4 AS d FROM obs),
  h(bvid, k, e, c, n) AS (SELECT DISTINCT bvid, 0::BIGINT, 3::BIGINT, NULL::BIGINT, 0::BIGINT FROM a UNION ALL
    SELECT bvid, k, CASE WHEN d <= e OR m >= 2 THEN d ELSE e END, CASE WHEN d <= e OR m >= 2 THEN NULL ELSE d END, CASE WHEN d <= e OR m >= 2 THEN 0 ELSE m END
    FROM (SELECT a.bvid, a.k, d, e, CASE WHEN c = d THEN n + 1 ELSE 1 END AS m FROM h JOIN a ON a.bvid = h.bvid AND a.k = h.k + 1)),
  tiered AS (SELECT bvid, k, ['s', 'a', 'b', 'c'][e + 1] AS effective, ['s', 'a', 'b', 'c'][c + 1] AS candidate, n AS downgrades FROM h QUALIFY row_number() OVER (PARTITION BY bvid ORDER BY k DESC) = 1)"""
CLOSED = f"{OBS}, {WORDS}, closed AS (SELECT keyword, us // 86400000000 * 86400 AS bucket, count(DISTINCT rpid) AS n FROM obs, words WHERE contains(lower(content), keyword) GROUP BY ALL)"
ORACLES = {
    "keyword_trends": f"WITH {TREND} SELECT bucket, keyword, coalesce(d, 0) AS distinct_comments, coalesce(n, 0) AS observations FROM grid CROSS JOIN words LEFT JOIN counts USING (keyword, bucket)",
    "keyword_trends_evidence": f"WITH {TREND} SELECT bucket, keyword, coalesce(d, 0) AS distinct_comments, coalesce(n, 0) AS observations, coalesce(ids, '') AS raw_payload_ids, coalesce(ids, '') AS observation_ids FROM grid CROSS JOIN words LEFT JOIN counts USING (keyword, bucket)",
    "keyword_cooccurrence": f"WITH {DOCS}, w AS (SELECT unnest(['of', 'que', 'the', 'und']) AS k) SELECT x.k AS keyword_a, y.k AS keyword_b, count(DISTINCT rpid) AS distinct_comments, count(DISTINCT id) AS observations FROM docs, w x, w y WHERE x.k < y.k AND contains(folded, x.k) AND contains(folded, y.k) GROUP BY ALL",
    "stance_evidence": f"WITH {DOCS}, {LEX}, t AS (SELECT *, array_to_string(list_filter(string_split_regex(folded, '\\s+'), lambda x: x <> ''), ' ') AS phrase FROM docs), h AS (SELECT category, term, id, bvid, rpid FROM t, lex WHERE contains(phrase, term)), per_term AS (SELECT category, term, count(DISTINCT id) AS n FROM h GROUP BY ALL), terms AS (SELECT category, string_agg(term || '=' || n, ',' ORDER BY term) AS terms FROM per_term GROUP BY ALL), c AS (SELECT category, count(DISTINCT (bvid, rpid)) AS d, count(DISTINCT id) AS n FROM h GROUP BY ALL) SELECT l.category, coalesce(d, 0) AS distinct_comments, coalesce(n, 0) AS observations, coalesce(terms, '') AS terms FROM (SELECT DISTINCT category FROM lex) l LEFT JOIN c USING (category) LEFT JOIN terms USING (category)",
    "hot_turnover": f"WITH {TURNOVER} SELECT bvid, previous_page_id, current_page_id, captured_at, retained, array_to_string(entered, ',') AS entered, array_to_string(exited, ',') AS exited, round(rate, 6) AS turnover_rate FROM turnover",
    "hot_replay": f"WITH {PAGES}, {MEDIA}, m AS (SELECT id, count(*) AS n FROM media GROUP BY id) SELECT page_id, CAST(place AS BIGINT) AS position, rpid, on_page.id AS comment_observation_id, coalesce(n, 0) AS n_media FROM on_page LEFT JOIN m ON m.id = on_page.id WHERE place <= 5",
    "metric_replay": f"WITH {METRICS}, p AS (SELECT *, lag(us) OVER w AS wu, lag(view_count) OVER w AS wv, lag(like_count) OVER w AS wl, lag(coin_count) OVER w AS wc FROM metrics WHERE captured_at < TIMESTAMP '2024-01-25' WINDOW w AS (PARTITION BY bvid ORDER BY us, raw_payload_id)) SELECT bvid, us AS captured_at, raw_payload_id, (us - wu) // 1000000 AS elapsed_seconds, view_count - wv AS view_count_delta, like_count - wl AS like_count_delta, coin_count - wc AS coin_count_delta FROM p WHERE captured_at >= TIMESTAMP '2024-01-05'",
    "view_growth": f"WITH {METRICS}, {GROWTH} SELECT * FROM growth",
    "latest_metrics": f"WITH {METRICS} SELECT bvid, us AS captured_at, view_count, like_count FROM metrics WHERE us < {NOW}000000 QUALIFY row_number() OVER (PARTITION BY bvid ORDER BY us DESC, raw_payload_id DESC) = 1",
    "recent_topn": f"WITH {METRICS} SELECT bvid, us AS captured_at, view_count, raw_payload_id FROM metrics QUALIFY row_number() OVER (PARTITION BY bvid ORDER BY us DESC, raw_payload_id DESC) <= 5",
    "latest_availability": f"WITH {METRICS}, {VIDEOS}, l AS (SELECT bvid, arg_max(status, us) AS status FROM metrics GROUP BY bvid) SELECT bvid, coalesce(status, 'visible') = 'visible' AS available FROM videos LEFT JOIN l USING (bvid)",
    "state_changes": f"WITH {CHANGES} SELECT * FROM changes",
    "visibility_transitions": f"WITH {SEEN} SELECT * FROM vis",
    "visibility_replay": f"WITH {SEEN} SELECT vis.*, p.raw_payload_id AS previous_raw_payload_id, p.us AS previous_captured_at, c.raw_payload_id AS current_raw_payload_id, c.us AS current_captured_at FROM vis LEFT JOIN (SELECT * FROM obs WHERE event_type <> 'signup') p ON p.id = previous_id LEFT JOIN (SELECT * FROM obs WHERE event_type <> 'signup') c ON c.id = current_id",
    "comment_entities": f"WITH {OBS} SELECT rpid, bvid, content AS first_content, us AS first_seen_at, raw_payload_id AS first_raw_payload_id, author_mid FROM obs QUALIFY row_number() OVER (PARTITION BY rpid ORDER BY us, id) = 1",
    "watchlist": f"""WITH {OBS}, p AS (SELECT *, reply_count - lag(reply_count) OVER w AS dr, like_count - lag(like_count) OVER w AS dl, row_number() OVER w = 1 AS first_seen, (CASE WHEN contains(lower(content), 'error') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(content), 'purchase') THEN 1 ELSE 0 END) AS hits FROM obs WHERE coalesce(root_rpid, 0) = 0 WINDOW w AS (PARTITION BY rpid ORDER BY us, id)),
 s AS (SELECT *, CASE WHEN sort_mode = 'hot' AND position BETWEEN 0 AND 3 THEN 100 - position END AS p0, CASE WHEN dr >= 5 THEN 80 + least(dr, 19) END AS p1, CASE WHEN dl >= 20 THEN 70 + least(dl // 5, 19) END AS p2, CASE WHEN hits > 0 THEN 75 + least(hits - 1, 4) END AS p3 FROM p),
 c AS (SELECT *, greatest(p0, p1, p2, p3) AS top, CASE WHEN first_seen THEN 2 ELSE 0 END AS bonus, coalesce(p0, 0) + CASE WHEN p1 IS NULL THEN 0 ELSE dr END + CASE WHEN p2 IS NULL THEN 0 ELSE dl / 5 END + CASE WHEN p3 IS NULL THEN 0 ELSE hits * 10 END AS raw FROM s WHERE coalesce(p0, p1, p2, p3) IS NOT NULL),
 d AS (SELECT *, CASE top WHEN p0 THEN 'hot_top' WHEN p1 THEN 'reply_growth' WHEN p2 THEN 'like_growth' ELSE 'controversy_keyword' END AS reason, least(top + bonus, 100) AS priority, raw + bonus AS score FROM c),
 r AS (SELECT *, row_number() OVER (PARTITION BY bvid, rpid ORDER BY priority DESC, us DESC, id DESC) AS best, row_number() OVER (PARTITION BY bvid, rpid ORDER BY us DESC, id DESC) AS latest, min(us) OVER (PARTITION BY bvid, rpid) AS first_us FROM d),
 x AS (SELECT *, '{{' || concat_ws(',', CASE WHEN p0 IS NOT NULL THEN '"hot_position":' || position END, CASE WHEN p1 IS NOT NULL THEN '"reply_delta":' || dr END, CASE WHEN p2 IS NOT NULL THEN '"like_delta":' || dl END,
   CASE WHEN hits > 0 THEN '"controversy_keywords":[' || concat_ws(',', CASE WHEN contains(lower(content), 'error') THEN '"error"' END, CASE WHEN contains(lower(content), 'purchase') THEN '"purchase"' END) || ']' END, CASE WHEN first_seen THEN '"recent_first_seen":true' END) || '}}' AS extra FROM r),
 h AS (SELECT bvid, rpid, position AS hot_position FROM d WHERE sort_mode = 'hot' QUALIFY row_number() OVER (PARTITION BY bvid, rpid ORDER BY us DESC, id DESC) = 1)
 SELECT b.bvid, b.rpid, b.rpid AS root_rpid, true AS active, b.reason, CAST(b.priority AS BIGINT) AS priority, round(CAST(b.score AS DOUBLE), 6) AS score, extra, CAST(hot_position AS BIGINT) AS hot_position, l.reply_count, l.like_count, l.id AS last_comment_observation_id, b.first_us AS first_seen_at, l.us AS last_seen_at, l.us + 86400000000 AS expires_at FROM x b JOIN r l ON b.bvid = l.bvid AND b.rpid = l.rpid AND l.latest = 1 LEFT JOIN h ON h.bvid = b.bvid AND h.rpid = b.rpid WHERE b.best = 1""",
    "media_changes": f"""WITH {MEDIA}, lists AS (SELECT id, rpid, list(media_source_id ORDER BY position, media_source_id) AS ids FROM media GROUP BY ALL), p AS (SELECT *, lag(id) OVER w AS pid, lag(ids) OVER w AS was FROM lists WINDOW w AS (PARTITION BY rpid ORDER BY id)), q AS (SELECT *, list_sort(list_distinct(ids)) <> list_sort(list_distinct(was)) AS changed FROM p WHERE was IS NOT NULL)
 SELECT rpid, pid AS previous_id, id AS current_id, 'media_changed' AS event_type, '' AS ids FROM q WHERE changed
 UNION ALL SELECT rpid, pid, id, 'media_added', array_to_string(list_sort(list_distinct(list_filter(ids, lambda x: NOT list_contains(was, x)))), ',') FROM q WHERE changed AND len(list_filter(ids, lambda x: NOT list_contains(was, x))) > 0
 UNION ALL SELECT rpid, pid, id, 'media_removed', array_to_string(list_sort(list_distinct(list_filter(was, lambda x: NOT list_contains(ids, x)))), ',') FROM q WHERE changed AND len(list_filter(was, lambda x: NOT list_contains(ids, x))) > 0
 UNION ALL SELECT rpid, pid, id, 'media_order_changed', '' FROM q WHERE NOT changed AND ids <> was""",
    "media_links": f"WITH {MEDIA} SELECT id AS comment_observation_id, position, media_source_id, rpid FROM media QUALIFY row_number() OVER (PARTITION BY id, position ORDER BY arrived, media_source_id) = 1",
    "exact_dedup": "SELECT sha256(text) AS blob_sha256, min(doc_id) AS asset_id, count(*) AS sources FROM documents GROUP BY 1",
    "reuse_ranking": "SELECT sha256(text) AS asset, count(DISTINCT doc_id) AS comments, count(DISTINCT source) AS videos FROM documents GROUP BY 1",
    "duplicate_display": f"WITH {PAGES} SELECT page_id, rpid, count(*) AS shown, string_agg(id, ',' ORDER BY id) AS observation_ids FROM on_page GROUP BY ALL HAVING count(*) > 1",
    "same_author_pairs": f"WITH {SAME} SELECT * FROM same",
    "template_candidates": f"WITH {EXACT} SELECT * FROM pairs",
    "template_candidates_keyword": f"WITH {EXACT.replace('FROM docs)', """FROM docs WHERE contains(lower(text), 'the'))""", 1)} SELECT * FROM pairs",
    "comment_flags": f"""WITH {PAGES}, {SAME.replace("docs AS", "docs AS", 1)}, shown AS (SELECT page_id, rpid FROM on_page GROUP BY ALL HAVING count(*) > 1), d AS (SELECT 'same_user_duplicate_submission' AS flag_type, subject_rpid, related_rpid, CAST(NULL AS VARCHAR) AS evidence_scope FROM same UNION ALL SELECT 'same_rpid_duplicate_display', rpid, NULL, page_id FROM shown)
 SELECT CAST(1 AS BIGINT) AS event_id, flag_type, subject_rpid, related_rpid, evidence_scope, sha256('{{"algorithm_version":"1","event_id":1,"evidence_scope":' || coalesce('"' || evidence_scope || '"', 'null') || ',"flag_type":"' || flag_type || '","related_rpid":' || coalesce(CAST(related_rpid AS VARCHAR), 'null') || ',"subject_rpid":' || subject_rpid || '}}') AS stable_key FROM d""",
    "propagation_nodes": f"""WITH {SAME}, win AS (SELECT * FROM docs WHERE s < 1706745600), own AS (SELECT author_mid, count(*) AS comments, count(DISTINCT bvid) AS videos, count(*) FILTER (rpid % 3 = 0 AND rpid <> 1) AS replies FROM win GROUP BY ALL),
 o AS (SELECT author_mid, count(*) AS origins FROM same WHERE subject_rpid IN (SELECT rpid FROM win) GROUP BY ALL), am AS (SELECT author_mid, count(*) AS amplified FROM same WHERE related_rpid IN (SELECT rpid FROM win) GROUP BY ALL),
 p AS (SELECT own.*, coalesce(origins, 0) AS origins, coalesce(amplified, 0) AS amplified, CASE WHEN author_mid = 4 THEN 1.0 ELSE 0.0 END AS official FROM own LEFT JOIN o USING (author_mid) LEFT JOIN am USING (author_mid)),
 m AS (SELECT max(videos) AS mv, max(replies) AS mr, max(origins) AS mo, max(amplified) AS ma FROM p), s AS (SELECT p.*, coalesce(origins / nullif(mo, 0), 0) AS originator, coalesce(amplified / nullif(ma, 0), 0) AS amplifier, CASE WHEN mv > 1 THEN (videos - 1) / (mv - 1) ELSE 0 END AS bridge, coalesce(replies / nullif(mr, 0), 0) AS responder FROM p, m)
 SELECT author_mid, CASE WHEN author_mid <> 2 THEN 'a' || author_mid END AS author_name, comments, videos, replies, origins, amplified, CASE WHEN author_mid = 4 THEN '2' ELSE '' END AS official_target_ids, round(originator::DOUBLE, 6) AS originator, round(amplifier::DOUBLE, 6) AS amplifier, round(bridge::DOUBLE, 6) AS bridge, round(responder::DOUBLE, 6) AS responder, official::DOUBLE AS official, round(greatest(originator, amplifier, bridge, responder, official)::DOUBLE, 6) AS overall FROM s""",
    "propagation_evidence": f"""WITH {SAME}, win AS (SELECT * FROM docs WHERE s < 1706745600) SELECT author_mid, 'comment' AS kind, rpid AS id FROM win UNION ALL SELECT author_mid, 'raw_payload', rpid FROM win
 UNION ALL SELECT DISTINCT author_mid, 'template_flag', subject_rpid * 1000000 + related_rpid FROM same WHERE subject_rpid IN (SELECT rpid FROM win) OR related_rpid IN (SELECT rpid FROM win)""",
    "flagged_counts": f"WITH {SAME} SELECT rpid, CAST(sum(o) AS BIGINT) AS origins, CAST(sum(1 - o) AS BIGINT) AS amplified FROM (SELECT subject_rpid AS rpid, 1 AS o FROM same UNION ALL SELECT related_rpid, 0 FROM same) GROUP BY rpid",
    "propagation_replay": f"""WITH {TALK}, {VIDEOS} SELECT 'video_associated' AS kind, 1704070800000000 AS at, bvid, CAST(NULL AS BIGINT) AS from_rpid, CAST(NULL AS BIGINT) AS to_rpid FROM videos
 UNION ALL SELECT 'comment_reply', s * 1000000, bvid, root_rpid, rpid FROM talk WHERE s < 1706745600 AND root_rpid IN (SELECT rpid FROM talk) UNION ALL SELECT 'template_propagation', s * 1000000, bvid, root_rpid, rpid FROM talk WHERE s < 1706745600 AND root_rpid IN (SELECT rpid FROM talk)""",
    "reply_edges": f"WITH {TALK} SELECT root_rpid, rpid, bvid, s * 1000000 AS first_seen_at FROM talk WHERE root_rpid IN (SELECT rpid FROM talk)",
    "comment_spike": f"WITH {C_SPIKE} SELECT * FROM spikes",
    "spike_evidence": f"""WITH {K_SPIKE}, {comment_spikes()}, e AS (SELECT signal_type, sp.scope, sp.bucket, rpid, CAST(NULL AS BIGINT) AS oid, raw_payload_id FROM spikes sp JOIN own ON own.us // 3600000000 * 3600 = sp.bucket
  UNION ALL SELECT signal_type, k.scope, k.bucket, rpid, id, raw_payload_id FROM kspikes k JOIN hits h ON h.keyword = k.scope AND h.s // 3600 * 3600 = k.bucket)
 SELECT DISTINCT signal_type, scope, bucket, 'comment' AS kind, rpid AS id FROM e UNION ALL SELECT DISTINCT signal_type, scope, bucket, 'observation', oid FROM e WHERE oid IS NOT NULL UNION ALL SELECT DISTINCT signal_type, scope, bucket, 'raw_payload', raw_payload_id FROM e""",
    "filtered_spikes": f"""WITH {K_SPIKE}, {comment_spikes("contains(lower(content), 'error')")} SELECT * FROM spikes UNION ALL SELECT * FROM kspikes WHERE scope = 'error'""",
    "keyword_spike": f"WITH {K_SPIKE} SELECT * FROM kspikes",
    "turnover_signal": f"WITH {TURNOVER} SELECT {T_SIGNAL}",
    "creator_signal": f"WITH {CREATOR} SELECT * FROM creators",
    "turnover_signal_evidence": f"""WITH {TURNOVER}, t AS (SELECT 'hot_turnover' AS signal_type, bvid AS scope, captured_at // 1000000 AS bucket, * FROM turnover WHERE rate >= 0.9)
 SELECT signal_type, scope, bucket, 'previous_page' AS kind, previous_page_id AS id FROM t UNION ALL SELECT signal_type, scope, bucket, 'current_page', current_page_id FROM t
 UNION ALL SELECT signal_type, scope, bucket, 'entered', CAST(unnest(entered) AS VARCHAR) FROM t UNION ALL SELECT signal_type, scope, bucket, 'exited', CAST(unnest(exited) AS VARCHAR) FROM t""",
    "creator_signal_evidence": f"""WITH {VIDEOS}, f AS (SELECT 'v' || (user_id % 15) AS bvid, epoch_us(ts) AS us, event_id, user_id FROM events WHERE event_id % 3 = 0 AND user_id = 3 AND ts < TIMESTAMP '2024-02-01'
  QUALIFY row_number() OVER (PARTITION BY 'v' || (user_id % 15) ORDER BY ts, event_id) = 1)
 SELECT 'major_creator_involvement' AS signal_type, bvid AS scope, us // 1000000 AS bucket, 't' || event_id AS title, user_id AS owner_mid, 'o' || user_id AS owner_name, CAST(1 AS BIGINT) AS event_target_id, 'major_creator' AS event_target_role, event_id AS raw_payload_id
 FROM f WHERE us >= 1704067200000000 AND bvid IN (SELECT bvid FROM videos WHERE active)""",
    "turning_points": f"SELECT * FROM (WITH {C_SPIKE} SELECT * FROM spikes) UNION ALL SELECT * FROM (WITH {K_SPIKE} SELECT * FROM kspikes) UNION ALL SELECT * FROM (WITH {TURNOVER} SELECT {T_SIGNAL}) UNION ALL SELECT * FROM (WITH {CREATOR} SELECT * FROM creators)",
    "timeline": f"""SELECT * FROM (
 SELECT * FROM (WITH {VIDEOS} SELECT 'event_video_associated' AS record_type, first_seen_at AS at, 'event_videos:1:' || bvid AS source_key, bvid FROM videos)
 UNION ALL SELECT * FROM (WITH {METRICS} SELECT 'video_metric_snapshot', us, 'video_metric_snapshots:' || bvid || ':' || strftime(captured_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN us % 1000000 = 0 THEN 'Z' ELSE '.' || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0') || 'Z' END, bvid FROM metrics)
 UNION ALL SELECT * FROM (WITH {CHANGES} SELECT 'comment_state_event', created_at, 'comment_state_events:' || rpid || ':' || current_id || ':' || event_type, bvid FROM changes)
 UNION ALL SELECT * FROM (WITH {SEEN} SELECT 'comment_visibility_event', created_at, 'comment_visibility_events:' || concat_ws(':', rpid, coalesce(current_id, previous_id), event_type), bvid FROM vis))
 WHERE bvid = 'v4' AND "at" >= 1704067200000000 AND "at" < epoch_us(TIMESTAMP '2024-01-25')""",
    "timeline_records": f"""SELECT record_type, "at", source_table, source_table || ':' || key AS source_key, bvid, CAST(data AS VARCHAR) AS data FROM (
 SELECT * FROM (WITH {VIDEOS} SELECT 'event_video_associated' AS record_type, first_seen_at AS at, 'event_videos' AS source_table, '1:' || bvid AS key, bvid, to_json({{'active': active, 'association_reason': association_reason, 'confidence': confidence}}) AS data FROM videos)
 UNION ALL SELECT * FROM (WITH {METRICS} SELECT 'video_metric_snapshot', us, 'video_metric_snapshots', bvid || ':' || strftime(captured_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN us % 1000000 = 0 THEN 'Z' ELSE '.' || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0') || 'Z' END, bvid, to_json({{'view_count': view_count, 'like_count': like_count, 'coin_count': coin_count, 'raw_payload_id': raw_payload_id}}) FROM metrics)
 UNION ALL SELECT * FROM (WITH {CHANGES} SELECT 'comment_state_event', created_at, 'comment_state_events', rpid || ':' || current_id || ':' || event_type, bvid, to_json({{'rpid': rpid, 'event_type': event_type, 'previous_comment_observation_id': previous_id, 'current_comment_observation_id': current_id, 'old_value': old_value, 'new_value': new_value}}) FROM changes)
 UNION ALL SELECT * FROM (WITH {SEEN} SELECT 'comment_visibility_event', created_at, 'comment_visibility_events', concat_ws(':', rpid, coalesce(current_id, previous_id), event_type), bvid, to_json({{'rpid': rpid, 'event_type': event_type, 'previous_comment_observation_id': previous_id, 'current_comment_observation_id': current_id, 'old_visibility': old_visibility, 'new_visibility': new_visibility}}) FROM vis))
 WHERE "at" >= 1704067200000000 AND "at" < 1706745600000000""",
    "coverage": f"""WITH {COVERAGE}, v AS (SELECT s_suppkey AS target_id FROM supplier WHERE s_suppkey % 5 <> 0), c AS (SELECT * FROM cover WHERE target_id IN (SELECT target_id FROM v)),
 s AS (SELECT (SELECT count(*) FROM v) AS active_videos, count(DISTINCT target_id) AS covered_videos, count(*) AS coverage_rows, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'failed') AS failed, CAST(coalesce(sum(pages_requested), 0) AS BIGINT) AS pages_requested, CAST(coalesce(sum(pages_succeeded), 0) AS BIGINT) AS pages_succeeded, CAST(coalesce(sum(request_errors), 0) AS BIGINT) AS request_errors, count(*) FILTER (truncated) AS truncated, CAST(coalesce(sum(items_observed), 0) AS BIGINT) AS items_observed, CAST(coalesce(sum(raw_payloads_saved), 0) AS BIGINT) AS raw_payloads_saved, CAST(coalesce(sum(parse_errors), 0) AS BIGINT) AS parse_errors, count(*) FILTER (corrupted) AS corrupted, CAST(min(started_at) - DATE '1970-01-01' AS BIGINT) AS first_day, CAST(max(finished_at) - DATE '1970-01-01' AS BIGINT) AS last_day FROM c)
 SELECT *, round(covered_videos / active_videos, 6) AS video_ratio, round(pages_succeeded / pages_requested, 6) AS page_ratio FROM s""",
    "coverage_window": f"""WITH {COVERAGE}, v AS (SELECT s_suppkey AS target_id FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey IN (1, 2, 3, 4, 5, 6, 7, 8)), c AS (SELECT * FROM cover WHERE target_id IN (SELECT target_id FROM v) AND finished_at >= DATE '1995-02-01' AND finished_at < DATE '1996-02-01'),
 s AS (SELECT (SELECT count(*) FROM v) AS active_videos, count(DISTINCT target_id) AS covered_videos, count(*) AS coverage_rows, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'failed') AS failed, CAST(coalesce(sum(pages_requested), 0) AS BIGINT) AS pages_requested, CAST(coalesce(sum(pages_succeeded), 0) AS BIGINT) AS pages_succeeded, CAST(coalesce(sum(request_errors), 0) AS BIGINT) AS request_errors, count(*) FILTER (truncated) AS truncated, CAST(coalesce(sum(items_observed), 0) AS BIGINT) AS items_observed, CAST(coalesce(sum(raw_payloads_saved), 0) AS BIGINT) AS raw_payloads_saved, CAST(coalesce(sum(parse_errors), 0) AS BIGINT) AS parse_errors, count(*) FILTER (corrupted) AS corrupted, CAST(min(started_at) - DATE '1970-01-01' AS BIGINT) AS first_day, CAST(max(finished_at) - DATE '1970-01-01' AS BIGINT) AS last_day FROM c)
 SELECT *, round(covered_videos / active_videos, 6) AS video_ratio, round(pages_succeeded / pages_requested, 6) AS page_ratio FROM s""",
    "coverage_by_kind": f"WITH {COVERAGE} SELECT task_kind, status, count(*) AS runs, CAST(sum(pages_requested) AS BIGINT) AS pages_requested, CAST(sum(pages_succeeded) AS BIGINT) AS pages_succeeded, count(*) FILTER (truncated) AS truncated FROM cover GROUP BY ALL",
    "failure_window": f"WITH {COVERAGE} SELECT count(*) AS runs, CAST(coalesce(sum(pages_requested), 0) AS BIGINT) AS pages_requested, CAST(coalesce(sum(pages_succeeded), 0) AS BIGINT) AS pages_succeeded, CAST(coalesce(sum(request_errors), 0) AS BIGINT) AS request_errors, CAST(coalesce(sum(parse_errors), 0) AS BIGINT) AS parse_errors FROM cover WHERE finished_at BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'",
    "queue_depth": "SELECT CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'succeeded' ELSE 'running' END AS status, o_orderpriority AS kind, count(*) AS tasks, CAST(greatest(DATE '1998-12-31' - CAST(min(o_orderdate) AS DATE), 0) AS BIGINT) AS oldest_days FROM orders GROUP BY ALL",
    "core_videos": f"""WITH {METRICS}, {VIDEOS}, l AS (SELECT * FROM metrics WHERE us < {NOW}000000 QUALIFY row_number() OVER (PARTITION BY bvid ORDER BY us DESC, raw_payload_id DESC) = 1), i AS (SELECT * FROM metrics WHERE us < {NOW}000000 AND raw_payload_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY bvid ORDER BY us DESC, raw_payload_id DESC) = 1)
 SELECT v.bvid, active, association_reason, confidence, first_seen_at, 't' || i.raw_payload_id AS title, i.owner_mid, 'o' || i.owner_mid AS owner_name, i.raw_payload_id AS info_raw_payload_id, l.us AS captured_at, l.view_count, l.like_count, l.coin_count, l.raw_payload_id FROM videos v LEFT JOIN l USING (bvid) LEFT JOIN i USING (bvid)""",
    "failure_streak": f"""WITH {OBS}, g AS (SELECT bvid, us, id, event_type <> 'view' AS failed, CASE WHEN reply_count < 20 THEN reply_count END AS retry, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY bvid ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS island FROM obs), i AS (SELECT bvid, island, count(*) FILTER (failed) AS streak FROM g GROUP BY ALL), l AS (SELECT bvid, streak, island FROM i QUALIFY row_number() OVER (PARTITION BY bvid ORDER BY island DESC) = 1),
 r AS (SELECT g.bvid, retry FROM g JOIN l ON g.bvid = l.bvid AND g.island = l.island QUALIFY row_number() OVER (PARTITION BY g.bvid ORDER BY us DESC, id DESC) = 1) SELECT l.bvid, streak, CASE WHEN streak > 0 THEN CAST(least(coalesce(retry, 300) * pow(2, least(streak - 1, 5)), 3600) AS BIGINT) ELSE 0 END AS backoff_seconds FROM l LEFT JOIN r USING (bvid)""",
    "alert_transitions": f"""WITH {COVERAGE}, d AS (SELECT task_kind AS alert_key, sum(request_errors) / sum(pages_requested) >= 0.155 AS t FROM cover GROUP BY ALL), s AS (SELECT DISTINCT o_orderpriority AS alert_key, CAST(substring(o_orderpriority, 1, 1) AS BIGINT) AS n FROM orders), j AS (SELECT alert_key, n % 2 = 1 AS was, n AS occ, CASE WHEN n <> 3 THEN 1000 * n END AS told, t FROM s LEFT JOIN d USING (alert_key)),
 x AS (SELECT *, CASE WHEN t AND NOT was THEN 'triggered' WHEN t AND was AND (told IS NULL OR 6000 - told >= 3600) THEN 'repeated' WHEN NOT t AND was THEN 'resolved' ELSE 'none' END AS action FROM j) SELECT alert_key, action, coalesce(t, was) AS active, occ + CASE WHEN t THEN 1 ELSE 0 END AS occurrences, CASE WHEN action IN ('triggered', 'repeated') THEN 6000 ELSE told END AS notified_at FROM x""",
    "signature_edges": f"WITH {SIGNS} SELECT a, b, distance, greatest(1 - distance / 64, 0)::DOUBLE AS confidence FROM edges",
    "signature_clusters": f"WITH RECURSIVE {SIGNS}, {closure('edges', 'a', 'b')} SELECT cluster, node AS member, distance FROM parts LEFT JOIN edges ON a = cluster AND b = node",
    "template_clusters": f"WITH RECURSIVE {EXACT}, {closure('pairs', 'left_rpid', 'right_rpid')} SELECT node AS rpid, cluster FROM parts",
    "evidence_index": f"WITH {CHANGES} SELECT DISTINCT 'observation' AS kind, x AS id FROM (SELECT previous_id AS x FROM changes UNION ALL SELECT current_id FROM changes) WHERE x IS NOT NULL UNION ALL SELECT DISTINCT 'raw_payload', event_id FROM events",
    "page_flatten": f"WITH {TALK} SELECT rpid, 'c' || conv_id AS bvid, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, nullif(root_rpid, 0) AS root_rpid, turn % 2 AS author_mid, role AS author_name, sha256(trim(text)) AS content_hash, 'visible' AS visibility FROM talk",
    "page_facts": f"WITH {TALK} SELECT conv_id AS raw_payload_id, 'c' || conv_id AS bvid, count(*) AS item_count, false AS is_end, 'parsed' AS status FROM talk GROUP BY conv_id",
    "page_chain_audit": f"""WITH {TALK}, p AS (SELECT conv_id AS crawl, turn, 'c' || (turn % 5) AS cursor, lag('c' || ((turn + 1) % 5)) OVER (PARTITION BY conv_id ORDER BY turn) AS expected, row_number() OVER (PARTITION BY conv_id, turn % 5 ORDER BY turn) > 1 AS again FROM talk), g AS (SELECT crawl, count(*) AS pages, count(*) FILTER (again) AS loops, count(*) FILTER (expected IS NOT NULL AND expected IS DISTINCT FROM cursor) AS broken, bool_or(turn IN (3, 7)) AS anchor_reached, bool_or(turn = 4) AS ended FROM p GROUP BY crawl) SELECT *, ended AND NOT anchor_reached AS missing FROM g""",
    "tier_assessment": f"""WITH {ASSESSED}, x AS (SELECT *, 'a' AS eff, CASE WHEN n % 3 = 0 THEN 'c' END AS cand, CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS cnt FROM tiered), y AS (SELECT *, {RANK.format("desired")} > 2 AS lower, CASE WHEN cand = desired THEN cnt + 1 ELSE 1 END AS k FROM x) SELECT bvid, desired, CASE WHEN NOT lower OR k >= 2 THEN desired ELSE eff END AS effective, CASE WHEN NOT lower OR k >= 2 THEN NULL ELSE desired END AS candidate, CAST(CASE WHEN NOT lower OR k >= 2 THEN 0 ELSE k END AS BIGINT) AS downgrades FROM y""",
    "life_stage": f"WITH {ASSESSED}, x AS (SELECT bvid, age + n * 172800 AS age, coalesce(n % 4 <> 0 AND v < 1200, false) AS low FROM a) SELECT bvid, CASE WHEN low AND age >= 2592000 THEN 'archived' WHEN low AND age >= 604800 THEN 'dormant' ELSE 'active' END AS life_stage FROM x",
    "next_due": f"WITH {ASSESSED}, x AS (SELECT bvid, anchor, CAST(least({AGE_STEP.format(age='age')}, CASE desired WHEN 's' THEN 120 WHEN 'a' THEN 600 WHEN 'b' THEN 1800 ELSE 3600 END) AS BIGINT) AS step FROM tiered) SELECT bvid, step AS interval, CAST(CASE WHEN {NOW} < anchor THEN anchor ELSE anchor + (({NOW} - anchor) // step + 1) * step END AS BIGINT) AS next_due FROM x",
    "checkpoint_slots": f"WITH {SLOTS} SELECT bvid, anchor, discovered, hours, due, state FROM states",
    "recovery_slots": f"WITH {SLOTS} SELECT bvid, max(hours) AS hours, count(*) AS coalesced FROM states WHERE state = 'missed' GROUP BY bvid",
    "schedule_gaps": f"WITH {ASSESSED}, x AS (SELECT bvid, anchor + n * 86400 AS due, n * 600 + 60 AS step FROM a) SELECT bvid, due AS gap_from, CAST({NOW} AS BIGINT) AS gap_until, ({NOW} - due) // step AS missed FROM x WHERE {NOW} - due >= step",
    "cohort_status": f"""WITH {OBS}, c AS (SELECT rpid AS cohort, list_element(['pending', 'complete', 'blocked', 'not_applicable', 'missed_due_to_capacity', 'complete', 'running', 'corrupted'], CASE WHEN rpid % 11 = 0 THEN reply_count % 8 + 1 WHEN rpid % 3 = 0 THEN 2 ELSE rpid % 5 + 1 END) AS s, reply_count > 50 AS started FROM obs WHERE reply_count > 10),
 g AS (SELECT cohort, bool_or(s = 'corrupted') AS cor, bool_or(s = 'running') AS act, bool_and(s = 'pending') AS allp, bool_and(s = 'not_applicable') AS nothing, bool_or(started OR s IN ('running', 'complete', 'corrupted')) AS st, bool_and(s IN ('blocked', 'not_applicable')) AS allb, bool_or(s = 'missed_due_to_capacity') AS mis, bool_and(s IN ('complete', 'not_applicable')) AS comp, bool_or(s = 'pending') AS pend, bool_and(s IN ('pending', 'blocked', 'not_applicable')) AS wait FROM c GROUP BY cohort)
 SELECT cohort, CASE WHEN cor THEN 'corrupted' WHEN act THEN 'running' WHEN allp THEN 'planned' WHEN nothing THEN 'not_applicable' WHEN NOT st AND allb THEN 'blocked' WHEN NOT st AND mis THEN 'missed' WHEN comp THEN 'complete' WHEN st AND pend THEN 'running' WHEN NOT st AND wait THEN 'planned' ELSE 'partial' END AS status FROM g""",
    "due_list": f"WITH {ASSESSED}, x AS (SELECT bvid, anchor, {NOW} - n * 900 AS last, v FROM a WHERE n % 5 <> 0), y AS (SELECT *, {AGE_STEP.format(age='greatest(last - anchor, 0)')} AS step FROM x), z AS (SELECT bvid, CAST(CASE WHEN last < anchor THEN anchor ELSE anchor + ((last - anchor) // step + 1) * step END AS BIGINT) AS due FROM y) SELECT * FROM z WHERE due <= {NOW}",
    "terminal_list": f"WITH {ASSESSED} SELECT bvid, '2024-01-20' AS date FROM a WHERE n % 5 <> 0 AND bvid <> 'v1' AND first_us <= epoch_us(TIMESTAMP '2024-01-20 14:00:00')",
    "raw_integrity": "SELECT CASE WHEN doc_id % 7 = 0 THEN 'size_mismatch' WHEN doc_id % 10 = 0 THEN 'hash_mismatch' ELSE 'ok' END AS outcome, count(*) AS payloads, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY 1",
    "month_layout": "SELECT strftime(o_orderdate, '%Y-%m') AS captured_month, count(*) AS rows FROM orders GROUP BY 1",
    "folded_texts": "SELECT doc_id, sha256(replace(lower(text), 'ß', 'ss')) AS folded_sha256 FROM documents",
    "stream_trends": f"WITH {OBS}, {WORDS} SELECT keyword, us // 86400000000 * 86400 AS bucket, count(DISTINCT rpid) AS distinct_comments, count(*) AS observations FROM obs, words WHERE contains(lower(content), keyword) GROUP BY ALL",
    "template_cluster_edges": f"WITH RECURSIVE {CLUSTERED} SELECT cluster_id, left_rpid, right_rpid, similarity, seconds_apart FROM edges",
    "template_cluster_members": f"WITH RECURSIVE {CLUSTERED} SELECT cluster_id, rpid, bvid, author_mid, author_name, sha256(content) AS content, first_seen_at, raw_payload_id FROM members JOIN records USING (rpid)",
    "template_cluster_summaries": f"""WITH RECURSIVE {CLUSTERED} SELECT cluster_id, count(*) AS members, count(DISTINCT bvid) AS videos, count(DISTINCT author_mid) AS authors, count(DISTINCT raw_payload_id) AS raw_payloads, min(first_seen_at) AS first_seen_at, max(first_seen_at) AS last_seen_at,
 true AS candidate_only, 'candidate_only_not_proof_of_coordination' AS interpretation_limit FROM members JOIN records USING (rpid) GROUP BY cluster_id""",
    "template_candidate_records": f"""WITH {EXACT}, {RECORDS} SELECT p.*, 7::BIGINT AS event_id, 'e-7' AS event_slug, 86400::BIGINT AS window_seconds, 1.0::DOUBLE AS min_similarity, true AS candidate_only,
 l.author_mid AS left_author_mid, l.author_name AS left_author_name, sha256(l.content) AS left_content, l.first_seen_at AS left_first_seen_at, l.raw_payload_id AS left_raw_payload_id,
 r.author_mid AS right_author_mid, r.author_name AS right_author_name, sha256(r.content) AS right_content, r.first_seen_at AS right_first_seen_at, r.raw_payload_id AS right_raw_payload_id
 FROM pairs p JOIN records l ON l.rpid = p.left_rpid JOIN records r ON r.rpid = p.right_rpid""",
    "cohort_plans": f"""WITH v AS (SELECT c_custkey AS c, 'v' || c_custkey AS bvid, ['s', 'a', 'b', 'c'][c_custkey % 4 + 1] AS tier, ['active', 'dormant', 'archived'][c_custkey % 3 + 1] AS stage, [3, 2, 1, 1][c_custkey % 4 + 1] AS core, [5, 4, 3, 1][c_custkey % 4 + 1] AS total FROM customer),
 due AS (SELECT *, ['planned', 'missed', 'not_applicable', 'not_applicable', 'missed'][(c + hours // 6) % 5 + 1] AS state FROM (SELECT *, unnest([6, 12, 18, 24]) AS hours FROM v)),
 defaults AS (SELECT bvid, hours, state, c, 'video_metrics' AS kind, NULL::BIGINT AS lo, NULL::BIGINT AS hi FROM due UNION ALL SELECT bvid, hours, state, c, 'latest_reconciliation', NULL, NULL FROM due UNION ALL SELECT bvid, hours, state, c, 'hot_core', 1, core FROM due UNION ALL SELECT bvid, hours, state, c, 'hot_deep', core + 1, total FROM due WHERE total > core),
 tried AS (SELECT 'v' || o_custkey AS bvid, [6, 12, 18, 24][l_linenumber % 4 + 1] AS hours, ['video_metrics', 'hot_core', 'hot_deep', 'latest_reconciliation'][l_orderkey % 4 + 1] AS kind, l_returnflag AS flag, CASE WHEN l_suppkey % 2 = 0 THEN l_partkey % 3 + 1 END AS lo, CASE WHEN l_suppkey % 2 = 0 THEN l_partkey % 3 + 1 + l_linenumber END AS hi
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey QUALIFY row_number() OVER (PARTITION BY o_custkey, l_linenumber % 4, l_orderkey % 4 ORDER BY l_orderkey * 10 + l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_returnflag DESC) = 1),
 lacking AS (SELECT * FROM defaults WHERE state = 'missed' AND (bvid, hours) NOT IN (SELECT bvid, hours FROM tried) UNION ALL
  SELECT d.bvid, d.hours, d.state, d.c, d.kind, CASE WHEN t.lo IS NOT NULL AND d.lo IS NOT NULL THEN t.lo ELSE d.lo END, CASE WHEN t.lo IS NOT NULL AND d.lo IS NOT NULL THEN t.hi ELSE d.hi END FROM defaults d JOIN tried t ON t.bvid = d.bvid AND t.hours = d.hours AND t.kind = d.kind WHERE state = 'missed' AND flag <> 'R'),
 late AS (SELECT bvid, max(hours) AS hours FROM due WHERE state = 'missed' GROUP BY bvid),
 recovery AS (SELECT bvid, late.hours, kind, lo, hi FROM lacking JOIN late USING (bvid) QUALIFY row_number() OVER (PARTITION BY bvid, kind ORDER BY coalesce(hi, 0) DESC, coalesce(hi - lo, 0) DESC, lacking.hours) = 1),
 free AS (SELECT * FROM v WHERE c % 7 <> 0 AND bvid NOT IN (SELECT bvid FROM recovery) AND bvid NOT IN (SELECT bvid FROM due WHERE state = 'planned' AND c % 3 = 0)),
 routine AS (SELECT *, 'video_metrics' AS kind, NULL::BIGINT AS lo, NULL::BIGINT AS hi FROM free UNION ALL SELECT *, 'hot_core', 1, CASE WHEN stage = 'dormant' THEN 1 ELSE core END FROM free WHERE stage <> 'archived'
  UNION ALL SELECT *, 'hot_deep', core + 1, total FROM free WHERE stage = 'active' AND c % 5 < 2 AND total > core UNION ALL SELECT *, 'latest_current_head', NULL, NULL FROM free WHERE stage = 'active' OR (stage = 'dormant' AND c % 2 = 0)),
 every AS (SELECT 'snapshot:' || bvid || ':age:' || hours || 'h' AS cohort_key, bvid, 'age_checkpoint' AS reason, kind, 120 AS base, lo, hi FROM defaults WHERE state = 'planned' UNION ALL
  SELECT 'snapshot:' || bvid || ':recovery:through:' || hours || 'h', bvid, 'recovery', kind, 115, lo, hi FROM recovery UNION ALL
  SELECT 'snapshot:' || bvid || ':' || strftime(make_timestamp({NOW} * 1000000::BIGINT), '%Y-%m-%dT%H:%M:%SZ') || ':routine', bvid, 'routine', kind, CASE tier WHEN 's' THEN 100 WHEN 'a' THEN 90 WHEN 'b' THEN 80 ELSE 70 END, lo, hi FROM routine)
 SELECT cohort_key, cohort_key || ':' || kind AS component_key, bvid, reason, kind AS component_kind, CAST(base + CASE kind WHEN 'video_metrics' THEN 2 WHEN 'hot_core' THEN 1 ELSE 0 END AS BIGINT) AS priority, lo AS start_page, hi AS end_page FROM every""",
    "cursor_chain_audit": """WITH RECURSIVE k AS (SELECT user_id % 97 AS crawl, event_id AS n, user_id, row_number() OVER w AS k, lag(event_id) OVER w AS prior, lead(event_id) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id % 97 ORDER BY ts, event_id)),
 p AS (SELECT crawl, n AS page, 'c' || CASE WHEN n % 53 = 0 THEN coalesce(prior, n) ELSE n END AS cursor, CASE WHEN n % 211 = 0 THEN 'nowhere' WHEN n % 389 = 0 AND k > 3 THEN 'c' || prior ELSE 'c' || after END AS onward, crawl % 4 = 0 AND user_id = crawl + 97 AS hit, after IS NULL AS is_end FROM k),
 heads AS (SELECT crawl, cursor, min(page) AS next, count(*) AS sharing FROM p GROUP BY crawl, cursor), links AS (SELECT p.*, next FROM p LEFT JOIN heads h ON h.crawl = p.crawl AND h.cursor = p.onward),
 walk(page, last, steps) AS (SELECT page, page, 0::BIGINT FROM links WHERE next IS NULL UNION ALL SELECT l.page, last, steps + 1 FROM walk JOIN links l ON l.next = walk.page),
 led AS (SELECT next AS page, count(*) AS led FROM links WHERE next IS NOT NULL GROUP BY next), each AS (SELECT links.*, last, steps, led FROM links LEFT JOIN walk USING (page) LEFT JOIN led USING (page)),
 anchored AS (SELECT last, max(steps) AS anchor_steps FROM each WHERE hit AND steps IS NOT NULL GROUP BY last)
 SELECT crawl, count(*) AS pages, coalesce(max(steps) + 1, 0) AS longest, count(*) FILTER (led IS NULL) AS roots, count(*) FILTER (next IS NULL) AS ends, count(*) FILTER (led > 1) AS merges, count(*) FILTER (onward IS NOT NULL AND next IS NULL AND NOT is_end) AS broken,
  count(*) FILTER (steps IS NULL) AS looping, bool_or(hit) AS anchor_reached, count(*) FILTER (steps < anchor_steps) AS beyond_anchor, bool_or(is_end) AS ended, coalesce(any_value(f.forks), 0) AS forks, bool_or(is_end) AND NOT bool_or(hit) AS missing
 FROM each LEFT JOIN anchored USING (last) LEFT JOIN (SELECT crawl, count(*) AS forks FROM heads WHERE sharing > 1 GROUP BY crawl) f USING (crawl) GROUP BY crawl""",
    "raw_archive": """WITH a AS (SELECT DISTINCT page_id % 10 AS d, page_id % 3 AS r, sha256(html) AS h, octet_length(encode(html)) AS n FROM pages WHERE html IS NOT NULL)
 SELECT strftime(DATE '2024-01-01' + CAST(d AS INT), '%Y-%m-%d') AS date, 'run' || r AS run, count(*) AS payloads, CAST(sum(n) AS BIGINT) AS bytes, count(*) AS intact FROM a GROUP BY d, r""",
    "raw_archive_day": "SELECT DISTINCT 'run' || (page_id % 3) AS run, sha256(html) AS payload_hash, '.html' AS suffix, octet_length(encode(html)) AS bytes, true AS intact FROM pages WHERE html IS NOT NULL AND page_id % 10 = 3",
    "visibility_replay_window": f"WITH {SEEN} SELECT vis.*, p.raw_payload_id AS previous_raw_payload_id, p.us AS previous_captured_at, c.raw_payload_id AS current_raw_payload_id, c.us AS current_captured_at FROM vis LEFT JOIN (SELECT * FROM obs WHERE event_type <> 'signup') p ON p.id = previous_id LEFT JOIN (SELECT * FROM obs WHERE event_type <> 'signup') c ON c.id = current_id WHERE created_at >= 1704412800000000 AND created_at < 1705276800000000",
    "template_flags": f"""WITH {EXACT}, d AS (SELECT 3::BIGINT AS event_id, 'template_like_comment' AS flag_type, left_rpid AS subject_rpid, right_rpid AS related_rpid, similarity AS confidence, 'sequence_matcher' AS algorithm, 'sequence_matcher-v1:min=1.000000:window=86400:minchars=4' AS algorithm_version FROM pairs)
 SELECT *, sha256('{{"algorithm_version":"' || algorithm_version || '","event_id":3,"evidence_scope":null,"flag_type":"' || flag_type || '","related_rpid":' || related_rpid || ',"subject_rpid":' || subject_rpid || '}}') AS stable_key FROM d""",
    "flags_refreshed": f"""WITH {PAGES}, {SAME}, shown AS (SELECT page_id, rpid FROM on_page GROUP BY ALL HAVING count(*) > 1), {EXACT[len(ALNUM) + 2:]},
 d AS (SELECT 'same_user_duplicate_submission' AS flag_type, subject_rpid FROM same UNION ALL SELECT 'same_rpid_duplicate_display', rpid FROM shown UNION ALL SELECT 'template_like_comment', left_rpid FROM pairs)
 SELECT flag_type, count(*) AS matched, count(*) FILTER (subject_rpid % 3 <> 0) AS created FROM d GROUP BY flag_type""",
    "target_states": f"WITH {LOG} SELECT * FROM targets",
    "target_keywords": f"WITH {LOG} SELECT event_id, target_id AS source_target_id, target_value AS keyword, normalized_value AS normalized_keyword, 1::BIGINT AS version, active, first_seen_at FROM targets WHERE target_type = 'keyword'",
    "target_tasks": f"WITH {LOG} SELECT 'fetch_video_stats:video:' || t.normalized_value || ':event:' || t.event_id AS idempotency_key, t.normalized_value AS target_id, log.priority, t.target_id AS source_target_id, 'event_seed' AS reason, log.ts AS not_before FROM targets t JOIN log ON log.k = t.target_id WHERE t.target_type = 'seed_bvid'",
    "target_videos": f"""WITH {LOG}, steps AS (SELECT l.event_id, l.normalized_value AS bvid, ts, k, target_id AS source, 'seed_bvid' AS reason, 1.0::DOUBLE AS confidence, NULL::BIGINT AS of_target, true AS state FROM adds l JOIN firsts USING (event_id, target_type, normalized_value) WHERE target_type = 'seed_bvid'
  UNION ALL SELECT event_id, bvid, ts, k, NULL, reason, confidence, NULL, true FROM log WHERE op = 'attach'
  UNION ALL SELECT l.event_id, l.normalized_value, ts, k, NULL, NULL, NULL, target_id, l.active FROM log l JOIN firsts USING (event_id, target_type, normalized_value) WHERE op = 'set_active' AND target_type = 'seed_bvid'),
 s AS (SELECT *, last_value(source IGNORE NULLS) OVER (PARTITION BY event_id, bvid ORDER BY ts, k ROWS UNBOUNDED PRECEDING) AS now FROM steps)
 SELECT event_id, bvid, arg_max(now, (ts, k)) AS source_target_id, arg_max(reason, (ts, k)) FILTER (reason IS NOT NULL) AS association_reason, arg_max(confidence, (ts, k)) FILTER (reason IS NOT NULL) AS confidence, arg_max(state, (ts, k)) FILTER (of_target IS NULL OR of_target = now) AS active,
  min(ts) FILTER (reason IS NOT NULL) AS first_seen_at, max(ts) FILTER (reason IS NOT NULL) AS last_seen_at FROM s GROUP BY event_id, bvid HAVING count(reason) > 0""",
    "tier_history": f"WITH {TIERED} SELECT bvid, effective, candidate, downgrades FROM tiered",
    "stream_tiers": f"WITH {TIERED} SELECT bvid, effective, k AS assessments FROM tiered",
    "stream_closed_counts": f"WITH {CLOSED} SELECT * FROM closed",
    "stream_spikes": f"""WITH {CLOSED}, s AS (SELECT keyword, bucket, n, lag(bucket) OVER w AS b, CASE WHEN lag(bucket) OVER w = bucket - 86400 THEN lag(n) OVER w ELSE 0 END AS was FROM closed WINDOW w AS (PARTITION BY keyword ORDER BY bucket))
 SELECT keyword, bucket, was, n, 'folded' AS kind FROM s WHERE b IS NOT NULL AND n >= greatest(3, was * 1.1::DOUBLE)""",
    "stream_state_changes": f"WITH {CHANGES} SELECT * FROM changes",
    "hot_change_payloads": f"""WITH {TURNOVER} SELECT current_page_id, 'previous' AS side, id AS raw_payload_id FROM turnover JOIN on_page ON page_id = previous_page_id
 UNION ALL SELECT current_page_id, 'current', id FROM turnover JOIN on_page ON page_id = current_page_id""",
    "hot_changes": f"WITH {TURNOVER}, e AS (SELECT page_id, string_agg(id, ',' ORDER BY id) AS ids FROM on_page GROUP BY page_id) SELECT current_page_id, p.ids AS previous_observation_ids, c.ids AS current_observation_ids FROM turnover LEFT JOIN e p ON p.page_id = previous_page_id LEFT JOIN e c ON c.page_id = current_page_id",
    "media_sources": "SELECT 'p' AS platform, sha256('https://x.org/' || (l_partkey % 50)) AS url_hash, 'https://x.org/' || (l_partkey % 50) AS source_url, epoch_us(CAST(min(o_orderdate) AS TIMESTAMP)) AS first_seen_at, epoch_us(CAST(max(o_orderdate) AS TIMESTAMP)) AS last_seen_at, arg_min(l_orderkey, (o_orderdate, l_orderkey)) AS first_page_id, arg_max(l_orderkey, (o_orderdate, l_orderkey)) AS last_page_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL",
    "known_videos": f"WITH {SIGHT} SELECT bvid, lpad(CAST(k AS VARCHAR), 12, '0') AS source_mid, us AS pubdate, us AS first_seen_at FROM sight QUALIFY row_number() OVER (PARTITION BY bvid ORDER BY us, k) = 1",
    "video_sources": f"WITH {SIGHT} SELECT bvid, pool_id AS source_mid, pool_type, pool_id, arg_min(k, (us, k)) % 2 = 0 AS official, true AS monitored, min(us) AS first_seen_at, max(us) AS last_seen_at, arg_max(k, (us, k)) AS last_page_id, true AS active FROM sight GROUP BY bvid, pool_type, pool_id",
    "discovery_priority": f"WITH {SIGHT}, n AS (SELECT bvid, max(us) AS pubdate FROM sight GROUP BY bvid HAVING min(us) >= epoch_us(TIMESTAMP '1993-01-01')) SELECT bvid, pubdate, CASE WHEN epoch_us(TIMESTAMP '1998-01-01') - pubdate > 120000000 THEN 'delayed_discovery' ELSE 'fresh_discovery' END AS reason, CAST(CASE WHEN epoch_us(TIMESTAMP '1998-01-01') - pubdate > 120000000 THEN 90 ELSE 100 END AS BIGINT) AS priority FROM n",
    "event_video_log": f"WITH {SIGHT} SELECT CAST(1 AS BIGINT) AS event_id, bvid, min(us) AS first_seen_at, max(us) AS last_seen_at, true AS active FROM sight GROUP BY bvid",
    "active_event_videos": "SELECT CAST(n_nationkey AS BIGINT) AS source_target_id, CAST(c_custkey AS BIGINT) AS bvid, n_regionkey <> 2 AS active FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "metric_flatten": f"WITH {METRICS} SELECT bvid, raw_payload_id, view_count, like_count, coin_count, CAST(NULL AS BIGINT) AS share_count FROM metrics",
    "info_flatten": f"WITH {METRICS} SELECT raw_payload_id, 't' || raw_payload_id AS title, owner_mid, 'x,y' AS tag_names, 'tag' AS tag_fields FROM metrics",
    "availability_flatten": f"WITH {METRICS} SELECT raw_payload_id, status, CAST(CASE WHEN status = 'deleted' THEN -404 ELSE 0 END AS BIGINT) AS code FROM metrics",
    "request_errors": "SELECT CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'forbidden' WHEN '2' THEN 'rate_limited' WHEN '3' THEN 'captcha' WHEN '4' THEN 'server_error' END AS kind, count(*) AS requests FROM orders GROUP BY 1",
    "run_summary": "SELECT CAST(o_orderkey % 10 AS BIGINT) AS run_id, count(*) AS started, count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS failed FROM orders GROUP BY 1",
    "slot_plan": f"WITH {ASSESSED}, x AS (SELECT *, CASE WHEN {NOW} < anchor THEN anchor ELSE anchor + (({NOW} - anchor) // 600 + 1) * 600 END AS slot FROM tiered) SELECT bvid, 'snapshot:' || bvid || ':' || strftime(make_timestamp(slot * 1000000), '%Y-%m-%dT%H:%M:%SZ') || ':routine' AS slot_key, CAST(CASE desired WHEN 's' THEN 100 WHEN 'a' THEN 90 WHEN 'b' THEN 80 ELSE 70 END AS BIGINT) AS priority, CAST(CASE WHEN n % 3 = 0 THEN 1 WHEN n % 3 = 2 OR n % 2 = 0 THEN 3 ELSE 2 END AS BIGINT) AS components FROM x",
    "finalized_components": "SELECT CASE WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'O' THEN CASE WHEN 1000000 > o_orderkey * 100 THEN 'missed_due_to_capacity' ELSE 'pending' END ELSE CASE WHEN 1000000 > o_orderkey * 100 THEN 'missed_due_to_service_gap' ELSE 'blocked' END END AS status, count(*) AS components FROM orders GROUP BY 1",
    "candidate_ranking": f"WITH {ASSESSED} SELECT bvid FROM (SELECT bvid FROM a ORDER BY n % 3 <> 0, CASE WHEN n % 3 <> 0 AND n % 2 = 0 THEN 1 ELSE 0 END, CASE WHEN n % 3 <> 0 AND n % 2 = 0 THEN anchor + n END, anchor, bvid LIMIT 10)",
    "focus_slots": f"WITH {OBS}, l AS (SELECT id, strftime(captured_at + INTERVAL 8 HOUR, '%H:%M') AS hm FROM obs) SELECT id FROM l WHERE hm IN ('10:00', '12:30', '15:15')",
    "alert_drafts": f"""WITH {COVERAGE}, t AS (SELECT sum(pages_requested) AS pages, sum(request_errors) AS errors FROM cover), w AS (SELECT count(*) FILTER (o_orderstatus = 'O') AS pending FROM orders)
 SELECT 'request_failure_rate' AS alert_key, 'critical' AS severity, pages >= 20 AND errors / pages >= 0.25 AS triggered FROM t UNION ALL SELECT 'task_backlog', 'warning', pending >= 1000 FROM w UNION ALL SELECT 'worker_heartbeat', 'critical', true
 UNION ALL SELECT 'scheduled_job_failure:' || n_name, 'critical', n_nationkey % 5 >= 3 FROM nation WHERE n_regionkey <> 1""",
    "coverage_statuses": "SELECT CASE WHEN l_linenumber = 7 THEN 'failed' WHEN l_orderkey % 97 = 0 THEN 'corrupted' WHEN l_linestatus = 'O' OR l_linenumber = 3 THEN 'partial' ELSE 'succeeded' END AS status, count(*) AS runs FROM lineitem GROUP BY 1",
    "failed_attempts": "SELECT o_orderkey, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS started_at, epoch_us(CAST(o_orderdate AS TIMESTAMP)) + (o_orderkey % 7 - 1) * 60000000 AS finished_at, CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'abandoned' END AS outcome, greatest((o_orderkey % 7 - 1) * 60000, 0) AS duration_ms FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderdate >= DATE '1995-01-01'",
    "comment_media": f"WITH {TALK}, l AS (SELECT rpid, 'https://x.org/' || conv_id AS base, '?q=' || turn AS q FROM talk) SELECT rpid, CAST(0 AS BIGINT) AS position, base || q AS url, base FROM l UNION ALL SELECT rpid, 1, base || q || '&b', base FROM l",
    "user_videos": "SELECT o_custkey AS source_mid, 'v' || o_orderkey AS bvid, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey + 1700000000 ELSE o_orderkey + 1600000000 END * 1000000 AS pubdate FROM orders WHERE o_orderkey % 5 <> 0 AND (o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0)",
    "planning_signals": f"""WITH {ASSESSED}, {SIGHT}, off AS (SELECT DISTINCT bvid FROM sight WHERE pool_id <> 'P' AND k % 2 = 0),
 h AS (SELECT bvid, max(us) AS last_at, arg_max(view_count, us) AS last, arg_max(view_count, us) FILTER (us <= {NOW - 3600}000000) AS base, max(us) FILTER (us <= {NOW - 3600}000000) AS base_at, arg_min(view_count, us) FILTER (us > {NOW - 3600}000000) AS first, min(us) FILTER (us > {NOW - 3600}000000) AS first_at
  FROM metrics WHERE us <= {NOW}000000 AND view_count IS NOT NULL GROUP BY bvid),
 r AS (SELECT bvid, CASE WHEN coalesce(base_at, first_at) <> last_at THEN greatest(last - coalesce(base, first), 0) END AS views_hour FROM h),
 s AS (SELECT a.bvid, anchor, CASE WHEN n = 9 THEN 'b' END AS pinned_tier, off.bvid IS NOT NULL AS official, n < 15 AND n % 3 = 0 AND n % 5 <> 0 AS event_core, views_hour, n % 2 = 0 AS frontier_complete, greatest({NOW} - anchor, 0) AS age_seconds, views_hour < 300 AS low_growth FROM a LEFT JOIN off USING (bvid) LEFT JOIN r USING (bvid))
 SELECT *, CASE WHEN event_core OR pinned_tier IS NOT NULL OR low_growth IS NOT TRUE THEN 'active' WHEN age_seconds >= 19 * 86400 THEN 'archived' WHEN age_seconds >= 18 * 86400 THEN 'dormant' ELSE 'active' END AS stage FROM s""",
    "entity_keys": f"""WITH {OBS}, o AS (SELECT rpid, us, id, event_type AS key, CASE WHEN id % 3 <> 0 THEN id END AS value FROM obs WHERE id % 5 <> 0 UNION ALL SELECT rpid, us, id, 'k' || (reply_count % 3), reply_count FROM obs WHERE id % 5 <> 0)
 SELECT rpid, key, value FROM o QUALIFY row_number() OVER (PARTITION BY rpid, key ORDER BY us, id) = 1""",
    "media_backfill": """WITH blobs AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_type) AS asset FROM part WHERE p_size % 7 <> 0)
 SELECT l_orderkey AS comment_observation_id, CAST(l_linenumber AS BIGINT) AS position, l_partkey AS media_source_id, asset AS media_asset_id FROM lineitem LEFT JOIN blobs ON l_partkey = p_partkey""",
    "assessment_signals": f"WITH {SIGHT}, v AS (SELECT bvid, CAST(substring(bvid, 2) AS BIGINT) AS n, bool_or(pool_id <> 'P' AND k % 2 = 0) AS official FROM sight GROUP BY bvid) SELECT bvid, official, n % 4 = 0 AS event_core, CASE WHEN n % 3 = 0 THEN n * 10 END AS views_hour FROM v",
    "hot_page_plan": "WITH t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 5 - c_custkey % 4 ELSE greatest(3 - c_custkey % 4, 1) END AS total FROM customer) SELECT id, CAST(1 AS BIGINT) AS core_start, CAST(least(total, 1) AS BIGINT) AS core_pages, CAST(2 AS BIGINT) AS deep_start, CAST(greatest(total - 1, 0) AS BIGINT) AS deep_pages FROM t",
    "active_targets": "SELECT c_custkey AS id, c_nationkey AS event_id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 2 = 0 AND c_custkey % 5 <> 0 AND n_nationkey % 6 <> 5 AND (n_nationkey % 4 = 0 OR n_nationkey % 4 <= 2) AND (n_nationkey % 3 = 0 OR n_nationkey % 3 > 1)",
    "month_window": "SELECT o_orderkey, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS at, strftime(o_orderdate, '%Y-%m') AS captured_month FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-15' AND o_orderdate < TIMESTAMP '1995-06-15'",
    "json_records": f"""WITH {TURNOVER} SELECT '{{"algorithm":"hot_turnover-v1","bvid":"' || bvid || '","captured_at":"' || strftime(make_timestamp(captured_at), '%Y-%m-%dT%H:%M:%SZ') || '","current_page_id":"' || current_page_id || '","entered":[' || array_to_string(entered, ',') || '],"interpretation_limit":"descriptive_only","retained":' || retained || ',"schema_version":1}}' AS value FROM turnover""",
    "event_report": f"""WITH {COVERAGE}, {VIDEOS}, k AS (SELECT task_kind, count(*) AS n FROM cover GROUP BY 1) SELECT '{{"coverage":[' || (SELECT string_agg('{{"runs":' || n || ',"task_kind":"' || task_kind || '"}}', ',' ORDER BY task_kind) FROM k) || '],"videos":[' || (SELECT string_agg('{{"active":' || active || ',"bvid":"' || bvid || '"}}', ',' ORDER BY CAST(substring(bvid, 2) AS BIGINT)) FROM videos) || ']}}' AS document""",
    "stream_pages": f"WITH {TALK} SELECT rpid, 'c' || conv_id AS bvid, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, turn % 2 AS author_mid FROM talk",
    "stream_visibility": f"WITH {SEEN} SELECT * FROM vis",
    "stream_intake": "SELECT event_id AS id, user_id AS rpid FROM events",
}
#: A stream that ends where a batch job ends is held against the batch job's SQL.
ORACLES["stream_watchlist"] = ORACLES["watchlist"]
#: A first batch of drafts finds no alerts: those that are triggered start.
ORACLES["stream_alerts"] = f"SELECT alert_key, 'triggered' AS action, true AS active, CAST(1 AS BIGINT) AS occurrences, CAST(6000 AS BIGINT) AS notified_at FROM ({ORACLES['alert_drafts']}) WHERE triggered"
ORACLES["report_sections"] = f"""SELECT 'coverage' AS section, coverage_rows || ':' || items_observed AS key FROM ({ORACLES["coverage"]}) UNION ALL SELECT 'key_timeline', source_key FROM ({ORACLES["timeline"]})
 UNION ALL SELECT 'core_videos', concat_ws(':', bvid, view_count) FROM ({ORACLES["core_videos"]}) UNION ALL SELECT 'hot_comment_changes', current_page_id || ':' || current_observation_ids FROM ({ORACLES["hot_changes"]})
 UNION ALL SELECT 'keyword_trends', concat_ws(':', keyword, bucket, distinct_comments) FROM ({ORACLES["keyword_trends"]}) UNION ALL SELECT 'template_clusters', cluster_id || ':' || members FROM ({ORACLES["template_cluster_summaries"]})
 UNION ALL SELECT 'evidence_index', kind || ':' || id FROM ({ORACLES["evidence_index"]}) UNION ALL SELECT 'event', 'e-7' UNION ALL SELECT 'window', '1704067200000000:1706745600000000'
 UNION ALL SELECT 'limitations', unnest(['only_successfully_collected_data_in_the_window', 'coverage_by_finish_time', 'absence_is_no_deletion_and_candidates_no_proof', 'check_against_raw_evidence'])
 UNION ALL SELECT 'limitations', CASE WHEN active_videos = 0 THEN 'no_active_videos' ELSE 'videos_without_coverage' END FROM ({ORACLES["coverage"]}) WHERE coalesce(video_ratio, 0) <> 1
 UNION ALL SELECT 'limitations', 'partial_or_failed_runs' FROM ({ORACLES["coverage"]}) WHERE partial > 0 OR failed > 0 UNION ALL SELECT 'limitations', 'truncated_or_corrupted_runs' FROM ({ORACLES["coverage"]}) WHERE truncated > 0 OR corrupted > 0"""
