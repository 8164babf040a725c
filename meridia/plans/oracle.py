"""The catalogue's queries as SQL for DuckDB. Written from the queries' definitions, with
plain joins and windows instead of the buckets and salts that the Spark side uses."""

from __future__ import annotations

_EV = "SELECT event_id, user_id, epoch_us(ts) AS ts_us, event_type, value, ts, props FROM events"
_ART = "SELECT page_id, sha256(html) AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS bytes FROM pages"
_REC = """SELECT page_id, sha256, CASE WHEN page_id % 7 = 1 THEN bytes + 1 ELSE bytes END AS bytes,
    CASE WHEN page_id % 7 = 2 THEN 'unknown' WHEN page_id % 7 = 3 THEN 'failed' ELSE 'confirmed' END AS result
  FROM art JOIN pages USING (page_id) WHERE url LIKE 'https:%'"""
_STATUS = f"""WITH art AS ({_ART}), rec AS ({_REC}), st AS (
  SELECT a.page_id, CASE
    WHEN bool_or(r.result = 'confirmed' AND r.sha256 = a.sha256 AND r.bytes = a.bytes) THEN 'sent'
    WHEN bool_or(r.result = 'unknown') THEN 'unknown' WHEN bool_or(r.result = 'failed') THEN 'delivery_failed'
    WHEN bool_or(r.page_id IS NOT NULL) THEN 'unproven' ELSE 'pending' END AS status
  FROM art a LEFT JOIN rec r USING (page_id) GROUP BY a.page_id)"""


def _verdict(parts: str, suffixes: str) -> str:
    """The shape rules of a column ``path``, in their order."""
    name = r"regexp_extract(path, '([^/]*)(?:/\.?)*$', 1)"
    return rf"""CASE WHEN starts_with(path, '/') THEN 'absolute' WHEN list_contains(string_split(path, '/'), '..') THEN 'parent'
      WHEN contains(path, '\') THEN 'backslash' WHEN contains(path, ':') THEN 'colon' WHEN list_has_any(string_split(path, '/'), [{parts}]) THEN 'part'
      WHEN list_contains([{suffixes}], lower(regexp_extract({name}, '^.+(\.[^.]+)$', 1))) THEN 'suffix'
      WHEN starts_with({name}, '.env') AND {name} <> '.env.example' THEN 'environment' ELSE 'ok' END"""


def _ignores(name: str) -> str:
    """The file rules of the query file_selection, the last one first."""
    rules = [("^fr/(.*/)?9[^/]*$", "true"), ("^es/4[^/]0$", "false"), ("^es/[0-4][^/]*$", "true"), ("^(.*/)?1[^/]$", "true"), ("^de/6[^/]*$", "false"), (r"^en/[^/]*\.html$", "false"), (r"^(.*/)?[^/]*\.html$", "true")]
    return "CASE " + " ".join(f"WHEN regexp_matches({name}, '{p}') THEN {v}" for p, v in rules) + " ELSE false END"


_RULES = r"""(VALUES (0, 'mail', '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]+'), (1, 'secret', '(secret|token|api_key|password)\s*[:=]'),
  (2, 'license', '[Ll]icense'), (3, 'address', '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}'), (4, 'long_number', '[0-9]{13,}')) r(place, rule, pattern)"""
_PLANTED = r"""p AS (
  SELECT doc_id, lang || '.' || source AS kind, text || chr(10) || CASE doc_id % 15
    WHEN 0 THEN 'glpat-' || repeat('a', 16) WHEN 1 THEN 'ghp_' || repeat('a', 20) WHEN 2 THEN 'github_pat_' || repeat('a', 19)
    WHEN 3 THEN 'ghu_' || repeat('a', 20) WHEN 4 THEN 'sk-proj-' || repeat('a', 20) WHEN 5 THEN '-----BEGIN RSA PRIVATE KEY-----'
    WHEN 6 THEN 'x -----BEGIN PRIVATE KEY-----' WHEN 7 THEN 'ou_' || repeat('a', 16) WHEN 8 THEN 'cli_' || repeat('b', 12)
    WHEN 9 THEN 'C:\Users\someone' WHEN 10 THEN 'https://someone:word@host.invalid/x' WHEN 11 THEN 'https://tenant.invalid/docx/' || repeat('T', 20)
    WHEN 12 THEN 'https://example.com/wiki/' || repeat('T', 20) WHEN 13 THEN 'DEM0VEH1CLE000001 DEM0VEH1CLE000009'
    ELSE 'WBA00000000000000 12345678901234567' END AS text FROM documents),
h AS (
  SELECT doc_id, kind, rule, place FROM p, (VALUES
    (0, 'credential', '\b(?:glpat-|ghp_|github_pat_)[A-Za-z0-9_-]{16,}'), (1, 'private_key', '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----'),
    (2, 'identity', '\b(?:ou|oc|om)_[a-f0-9]{16,}\b|\bcli_[a-f0-9]{12,}\b'), (3, 'user_path', '(?i)\b[A-Z]:[\\/]+Users[\\/]+[^\\/\s"\x27]+'),
    (4, 'authenticated_url', 'https?://[^/\s"\x27]+:[^/@\s"\x27]+@'), (7, 'private_key_line', '(?m)^-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----'),
    (8, 'access_token', '\b(?:glpat-|gh[pousr]_|github_pat_|sk-proj-)[A-Za-z0-9_-]{20,}')) r(place, rule, pattern) WHERE regexp_matches(text, pattern)
  UNION ALL SELECT DISTINCT doc_id, kind, 'tenant_resource', 5 FROM (
    SELECT doc_id, kind, unnest(regexp_extract_all(text, 'https?://([^/\s<>"\x27]+)/(?:sheets|docx|wiki)/([A-Za-z0-9]{20,})', 1)) AS host FROM p)
  WHERE host NOT IN ('example.feishu.cn', 'fixture.invalid', 'example.com')
  UNION ALL SELECT DISTINCT doc_id, kind, 'vehicle_id', 6 FROM (SELECT doc_id, kind, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+')) AS v FROM p)
  WHERE regexp_full_match(v, '[A-HJ-NPR-Z0-9]{17}') AND NOT regexp_full_match(v, '[0-9]+') AND v NOT IN (
    'DEM0VEH1CLE000001', 'DEM0VEH1CLE000002', 'DEM0VEH1CLEX00001', 'DEM0VEH1CLEX00002', 'DEM0VEH1CLEX00003', 'WBA123456789ABCDE', 'WBA00000000000000', 'L1234567890123456', 'L2234567890123456'))"""
_HITS = _PLANTED[_PLANTED.index("h AS (") :]
_GAP = f"SELECT user_id, event_id, ts_us, ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS gap_us FROM ({_EV})"

_DECODED = f"""fr AS (
  SELECT event_id, user_id % 7 AS message, ts_us, CAST(event_id AS HUGEINT) * 1103515245 * 4093 + user_id * 7919 AS be, CASE WHEN event_id % 10 = 0 THEN 3 ELSE 8 END AS size FROM ({_EV})),
frames AS (SELECT *, list_sum(list_transform(range(8), lambda i: ((be >> (56 - 8 * i)) & 255) << (8 * i))) AS le FROM fr),
dict AS (
  SELECT n_name AS signal, n_regionkey AS message, v.version, (n_nationkey * 5 + v.more) % 50 AS start, 1 + n_nationkey * 7 % 24 AS len, n_nationkey % 3 = 0 AS signed,
    CASE WHEN n_nationkey = 24 THEN 'other' WHEN n_nationkey % 2 = 0 THEN 'little' ELSE 'big' END AS byte_order, v.a, v.z
  FROM nation, (VALUES ('1', 0, -9e18::BIGINT, 1704067200000000 + 11 * 86400000000), ('2', 3, 1704067200000000 + 14 * 86400000000, 9e18::BIGINT)) v(version, more, a, z)),
met AS (SELECT f.*, d.* EXCLUDE (message), 8 * (d.start // 8) + 7 - d.start % 8 AS pos FROM frames f LEFT JOIN dict d ON d.message = f.message AND f.ts_us >= d.a AND f.ts_us < d.z),
cut AS (
  SELECT *, CASE WHEN signal IS NULL THEN CASE WHEN message IN (SELECT message FROM dict) THEN 'no_version' ELSE 'unknown_message' END WHEN byte_order = 'other' THEN 'bad_entry'
      WHEN CASE byte_order WHEN 'little' THEN start + len - 1 ELSE pos + len - 1 END // 8 >= size THEN 'short_payload' ELSE 'ok' END AS status,
    CASE byte_order WHEN 'little' THEN le >> start ELSE be >> greatest(0, 64 - pos - len) END & ((1::HUGEINT << len) - 1) AS bits FROM met),
decoded AS (
  SELECT event_id, message, signal, version, status,
    CAST(CASE WHEN status = 'ok' THEN CASE WHEN signed AND (bits >> (len - 1)) = 1 THEN bits - (1::HUGEINT << len) ELSE bits END END AS BIGINT) AS raw FROM cut)"""

ORACLE_SQL = {
    "aligned_timeline": f"""
        WITH e AS ({_EV}), f AS (SELECT user_id, event_id, ts_us FROM e WHERE event_type = 'error'),
        s AS (SELECT user_id, ts_us, event_id AS signal_id, value AS signal_value FROM e WHERE event_type = 'view')
        SELECT f.event_id, f.user_id, f.ts_us, s.signal_id, s.signal_value, f.ts_us - s.ts_us AS age_us,
               coalesce(n.n_name, CAST(c.c_nationkey AS VARCHAR), 'unknown') AS label
        FROM f ASOF LEFT JOIN s ON f.user_id = s.user_id AND f.ts_us >= s.ts_us
        LEFT JOIN customer c ON c.c_custkey = f.user_id LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    "window_scan": "SELECT event_id, user_id, event_type, value, epoch_us(ts) AS ts_us FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13'",
    "point_dedupe": f"""
        WITH p AS (SELECT user_id, ts_us, value FROM ({_EV}) WHERE event_type = 'view')
        SELECT * FROM p UNION SELECT user_id, ts_us, value + 1 FROM p WHERE user_id % 5 = 0""",
    "message_idempotency": f"SELECT event_id AS message_id, user_id AS vehicle, ts_us AS received_us FROM ({_EV})",
    "frame_interval": _GAP,
    "frame_rate": f"""
        SELECT user_id, CAST(floor(ts_us / 3600000000.0) * 3600000000 AS BIGINT) AS bucket_us, count(*) AS n, count(*) / 3600.0::DOUBLE AS per_second
        FROM ({_EV}) GROUP BY 1, 2""",
    "skip_events": f"SELECT * FROM ({_GAP}) WHERE gap_us > 21600000000",
    "latency_percentiles": """
        SELECT event_type, count(value) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99
        FROM events GROUP BY 1""",
    "latency_histogram": "SELECT event_type, CAST(floor(value / 10.0::DOUBLE) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2",
    "event_excerpts": f"""
        WITH e AS ({_EV}), p AS (
          SELECT a.event_id AS anchor_id, b.event_id, b.event_type, b.ts_us - a.ts_us AS offset_us,
                 row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.ts_us - a.ts_us), b.event_id) AS place
          FROM e a JOIN e b ON a.user_id = b.user_id AND abs(a.ts_us - b.ts_us) <= 1800000000
          WHERE a.event_type = 'error' AND b.event_type <> 'error')
        SELECT * FROM p WHERE place <= 5""",
    "state_islands": f"""
        WITH e AS ({_EV}), c AS (
          SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, event_id)
        ), i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS BIGINT) AS island FROM c)
        SELECT user_id, island, event_type, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n FROM i GROUP BY 1, 2, 3""",
    "activity_sessions": f"""
        WITH g AS ({_GAP}), s AS (
          SELECT *, sum(CASE WHEN gap_us <= 18000000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS k FROM g)
        SELECT user_id, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n FROM s GROUP BY user_id, k""",
    "stage_durations": f"""
        WITH d AS (SELECT user_id, floor(ts_us / 86400000000.0) AS day, event_type, max(ts_us) - min(ts_us) AS d FROM ({_EV}) GROUP BY 1, 2, 3)
        SELECT event_type, count(*) AS n, min(d) AS min_us, max(d) AS max_us, CAST(sum(d) AS BIGINT) AS total_us, count(*) FILTER (d > 900000000) AS over_limit FROM d GROUP BY 1""",
    "label_lookup": """
        SELECT c_custkey, CAST(c_nationkey + 3 AS BIGINT) AS code, coalesce(n_name, CAST(c_nationkey + 3 AS VARCHAR)) AS label
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey + 3""",
    "unknown_codes": """
        WITH k AS (SELECT try_cast(json_extract_string(props, '$.k') AS BIGINT) AS code FROM events)
        SELECT code, count(*) AS n FROM k WHERE code IS NOT NULL AND code NOT IN (SELECT n_nationkey FROM nation) GROUP BY 1""",
    "source_fallback": """
        SELECT o_custkey, year(o_orderdate) AS year, count(*) AS attempts, CASE
          WHEN bool_or(o_orderpriority <= '3' AND o_orderstatus = 'P') THEN 'error' WHEN bool_or(o_orderpriority <= '3' AND o_orderstatus = 'F') THEN 'primary'
          WHEN bool_or(o_orderpriority > '3' AND o_orderstatus = 'P') THEN 'error' WHEN bool_or(o_orderpriority > '3' AND o_orderstatus = 'F') THEN 'fallback' ELSE 'none' END AS chosen
        FROM orders GROUP BY 1, 2""",
    "same_environment": "SELECT l_orderkey, count(DISTINCT l_returnflag) AS environments, count(DISTINCT l_returnflag) = 1 AS consistent FROM lineitem GROUP BY 1",
    "complete_pages": "SELECT l_orderkey, count(DISTINCT l_linenumber) AS pages, count(*) AS expected, count(DISTINCT l_linenumber) = count(*) AS complete FROM lineitem GROUP BY 1",
    "branch_gate": """
        SELECT l_orderkey AS o_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1
        HAVING bool_and(l_shipdate >= o_orderdate) AND bool_or(l_returnflag <> 'R')""",
    "retry_selection": """
        WITH a AS (
          SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus) AS n FROM lineitem
        ), f AS (
          SELECT l_orderkey, min(n) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS first, min(n) FILTER (l_returnflag = 'R') AS stop, count(*) AS tried
          FROM a WHERE n <= 3 GROUP BY 1)
        SELECT l_orderkey, CASE WHEN first IS NOT NULL AND (stop IS NULL OR first < stop) THEN first END AS attempt,
          CASE WHEN first IS NOT NULL AND (stop IS NULL OR first < stop) THEN 'ok' WHEN stop IS NOT NULL THEN 'refused' ELSE 'exhausted' END AS status, tried FROM f""",
    "fair_queue": f"""
        WITH r AS (SELECT event_id, user_id, ts_us, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS round FROM ({_EV}) WHERE event_type = 'signup')
        SELECT *, row_number() OVER (ORDER BY round, ts_us, event_id) AS position FROM r""",
    "slot_admission": f"""
        WITH r AS (SELECT event_id, user_id, ts_us, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS round FROM ({_EV}) WHERE event_type = 'signup')
        SELECT * FROM r ORDER BY round, ts_us, event_id LIMIT 2""",
    "status_binding": f"""
        SELECT user_id, CAST(floor(ts_us / 86400000000.0) AS BIGINT) AS day, count(DISTINCT event_id) AS jobs,
          CASE WHEN count(DISTINCT event_id) = 1 THEN min(event_id) END AS job, CASE WHEN count(DISTINCT event_id) = 1 THEN 'bound' ELSE 'ambiguous' END AS status
        FROM ({_EV}) WHERE event_type = 'signup' GROUP BY 1, 2""",
    "task_status": f"""
        WITH a AS (SELECT user_id, CASE WHEN event_type IN ('view', 'click') THEN 'execution' ELSE 'delivery' END AS axis, ts_us, event_id, event_type AS state FROM ({_EV}))
        SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY user_id, axis ORDER BY ts_us DESC, event_id DESC) = 1""",
    "state_transitions": f"""
        WITH p AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS from_state, event_type AS to_state FROM ({_EV}))
        SELECT from_state, to_state, count(*) AS n, (from_state || '>' || to_state) IN ('signup>view', 'view>click', 'click>purchase', 'view>view') AS allowed
        FROM p WHERE from_state IS NOT NULL GROUP BY 1, 2""",
    "followup_next": """
        WITH t AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations)
        SELECT conv_id, min(turn) FILTER (next IS DISTINCT FROM 'assistant') AS next_seq, count(*) FILTER (next IS DISTINCT FROM 'assistant') AS waiting
        FROM t WHERE role = 'user' GROUP BY 1""",
    "recovery_eligible": """
        SELECT l_orderkey AS o_orderkey FROM lineitem
        WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority LIKE '1%')
        GROUP BY 1 HAVING bool_or(l_linenumber % 2 = 1 AND l_returnflag = 'N') AND NOT bool_or(l_linenumber % 2 = 0 AND l_returnflag = 'N')""",
    "interrupted_takeover": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'process alive' WHEN o_orderkey % 7 = 0 THEN 'children alive' WHEN NOT o_totalprice > 20000 THEN 'source invalid'
          WHEN o_orderstatus = 'F' THEN 'already reported' WHEN o_orderkey % 3 = 0 THEN 'lease changed' ELSE 'take over' END AS decision FROM orders""",
    "followup_registration": """
        SELECT page_id, url, CASE WHEN url NOT LIKE 'https:%' THEN 'not registered' WHEN page_id % 3 <> 0 THEN 'available' ELSE 'registration failed' END AS followup FROM pages""",
    "delivery_proof": f"{_STATUS} SELECT * FROM st",
    "delivery_resend": f"""{_STATUS} SELECT page_id, CASE WHEN status = 'unknown' THEN 'check' ELSE 'resend' END AS action
        FROM st JOIN art USING (page_id) WHERE status IN ('delivery_failed', 'unproven', 'unknown') AND bytes > 1500""",
    "completion_notices": f"{_STATUS} SELECT page_id, sha256 FROM art WHERE page_id NOT IN (SELECT page_id FROM st WHERE status = 'sent')",
    "artifact_validity": """
        WITH f AS (
          SELECT page_id, starts_with(html, '<!DOCTYPE html>') AS has_doctype, ends_with(html, '</html>') AS is_closed, contains(html, '<article>') AS has_article,
                 NOT regexp_matches(html, '<script[^>]+src=') AS self_contained, octet_length(encode(html)) BETWEEN 1000 AND 50000 AS in_size FROM pages)
        SELECT *, has_doctype AND is_closed AND has_article AND self_contained AND in_size AS valid FROM f""",
    "retention_plan": """
        SELECT o_orderkey, o_orderstatus FROM orders
        WHERE date_diff('day', CAST(o_orderdate AS DATE), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)) > 14""",
    "manifest_reconcile": """
        WITH a AS (SELECT doc_id, n_chars AS bytes FROM documents),
        m AS (SELECT doc_id, n_chars + CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS bytes FROM labels JOIN documents USING (doc_id)
              UNION ALL SELECT -1 - item_id, length(text) FROM benchmark)
        SELECT coalesce(a.doc_id, m.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN m.doc_id IS NULL THEN 'extra'
          WHEN a.bytes IS NOT DISTINCT FROM m.bytes THEN 'match' ELSE 'changed' END AS status
        FROM a FULL JOIN m ON a.doc_id = m.doc_id""",
    "provenance_subset": """
        WITH m AS (SELECT doc_id, CASE WHEN quality = 0 THEN sha256('changed') ELSE sha256(text) END AS expected FROM labels JOIN documents USING (doc_id)
                   UNION ALL SELECT -1 - item_id, sha256(text) FROM benchmark),
        a AS (SELECT doc_id, sha256(text) AS found FROM documents)
        SELECT m.doc_id, CASE WHEN found IS NULL THEN 'absent' ELSE 'differs' END AS reason FROM m LEFT JOIN a USING (doc_id) WHERE found IS DISTINCT FROM expected""",
    "file_digest": "SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents",
    "canonical_digest": """
        WITH e AS (SELECT CAST(floor(page_id / 100) AS BIGINT) AS manifest, 'pages/' || page_id || CASE page_id % 5 WHEN 1 THEN chr(31) WHEN 2 THEN chr(92) || 'u001F' ELSE '' END AS path, sha256(html) AS h FROM pages)
        SELECT manifest, count(*) AS entries, sha256('{' || string_agg('"' || replace(replace(path, chr(92), chr(92) || chr(92)), chr(31), chr(92) || 'u001f') || '":"' || h || '"', ',' ORDER BY path) || '}') AS digest FROM e GROUP BY 1""",
    "release_digest": """
        WITH e AS (SELECT 'pages/' || page_id AS path, sha256(html) AS h FROM pages)
        SELECT count(*) AS entries, sha256('{' || coalesce(string_agg('"' || path || '":"' || h || '"', ',' ORDER BY path), '') || '}') AS digest FROM e""",
    "case_collision": """
        WITH n AS (SELECT CASE WHEN p_size % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END || '/' || p_brand AS name FROM part)
        SELECT lower(name) AS folded, count(DISTINCT name) AS n FROM n GROUP BY 1 HAVING count(DISTINCT name) > 1""",
    "private_data_scan": f"WITH {_PLANTED} SELECT doc_id, rule, CAST(place AS BIGINT) AS place FROM h",
    "private_data_counts": f"""
        WITH {_PLANTED}, e AS (SELECT kind, count(*) AS n FROM h GROUP BY 1), f AS (SELECT kind, count(*) AS files FROM p GROUP BY 1)
        SELECT kind, files, coalesce(n, 0) AS errors, CASE WHEN n > 0 THEN 'failed' ELSE 'passed' END AS status FROM f LEFT JOIN e USING (kind)""",
    "private_paths": f"""
        WITH p AS (
          SELECT p_partkey, CASE WHEN p_partkey % 17 < 6 THEN 'a/' || ['private', 'secrets', '.lark-cli', 'data', 'wtv081', 'wheelhouse'][p_partkey % 17 + 1] || '/b.py'
            WHEN p_partkey % 17 < 14 THEN 'a/b.' || ['EXE', 'DLL', 'WHL', 'ZIP', 'PYC', 'PEM', 'KEY', 'PFX'][p_partkey % 17 - 5] WHEN p_partkey % 17 = 14 THEN 'a/.env.example'
            WHEN p_partkey % 17 = 15 THEN 'a/.' || ['exe', 'dll', 'whl', 'zip', 'pyc', 'pem', 'key', 'pfx'][p_partkey % 8 + 1] ELSE 'a/database/b.py' END AS path FROM part)
        SELECT p_partkey, path, {_verdict("'private', 'secrets', '.lark-cli', 'data', 'wtv081', 'wheelhouse'", "'.exe', '.dll', '.whl', '.zip', '.pyc', '.pem', '.key', '.pfx'")} AS verdict FROM p""",
    "rule_scan": f"SELECT doc_id, rule, CAST(place AS BIGINT) AS place FROM documents, {_RULES} WHERE regexp_matches(text, pattern)",
    "url_allowlist": r"""
        WITH h AS (SELECT regexp_extract(url, 'https?://([^/?#]+)', 1) AS host FROM pages WHERE regexp_matches(url, 'https?://([^/?#]+)'))
        SELECT host, count(*) AS n FROM h WHERE host NOT IN ('www.ththre.example.com', 'm.ththth.example.net', 'blog.tiontion.example.com') GROUP BY 1""",
    "vin_scan": r"""
        WITH t AS (
          SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'TESTVEH' || lpad(CAST(doc_id AS VARCHAR), 10, '0')
            WHEN doc_id % 3 = 1 THEN lpad(CAST(doc_id AS VARCHAR), 17, '1') ELSE 'SYNTHETC000000001' END AS token, text FROM documents
        ), f AS (SELECT doc_id, unnest(regexp_extract_all(' ' || text || ' ' || token || ' ', '[^A-Za-z0-9_]([A-HJ-NPR-Z0-9]{17})[^A-Za-z0-9_]', 1)) AS token FROM t)
        SELECT doc_id, token FROM f WHERE token <> 'SYNTHETC000000001' AND NOT regexp_matches(token, '^[0-9]+$')""",
    "path_shape": f"""
        WITH p AS (
          SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN '/' || p_name WHEN 1 THEN 'a/../' || p_name WHEN 2 THEN 'a/__pycache__/' || p_name WHEN 3 THEN p_name || '.PEM'
            WHEN 4 THEN 'x/.env.local' WHEN 5 THEN 'x/.env.example' WHEN 6 THEN p_name || '/.pem' WHEN 7 THEN p_name || '/.key.key' WHEN 8 THEN p_name || '.pem/'
            ELSE 'src/' || p_name || '.py' END AS path FROM part)
        SELECT p_partkey, {_verdict("'__pycache__', '.git', 'secrets'", "'.pem', '.key', '.pfx'")} AS verdict FROM p""",
    "json_validity": """
        WITH t AS (SELECT event_type, json_valid(CASE WHEN event_id % 6 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END) AS ok FROM events)
        SELECT event_type, count(*) AS n, count(*) FILTER (NOT ok) AS invalid FROM t GROUP BY 1""",
    "syntax_validity": "SELECT p_partkey, p_partkey % 3 <> 0 AS valid FROM part",
    "kind_counts": f"""
        WITH d AS (SELECT lang || '.' || source AS kind, text FROM documents), h AS (SELECT kind, count(*) AS errors FROM d, {_RULES} WHERE regexp_matches(text, pattern) GROUP BY 1)
        SELECT kind, count(*) AS files, coalesce(any_value(errors), 0) AS errors, CASE WHEN coalesce(any_value(errors), 0) > 0 THEN 'failed' ELSE 'passed' END AS status
        FROM d LEFT JOIN h USING (kind) GROUP BY 1""",
    "request_normalize": """
        WITH e AS (
          SELECT event_id, 'V' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS vehicle, date_trunc('minute', ts) AS a, date_trunc('minute', ts + INTERVAL 40 MINUTE) AS b
          FROM events WHERE event_type = 'signup')
        SELECT event_id, vehicle, CASE WHEN event_id % 5 <> 0 THEN epoch_us(a) - 28800000000 END AS start_us,
          CASE WHEN event_id % 5 <> 0 THEN epoch_us(b) - 28800000000 END AS end_us, CASE WHEN event_id % 5 = 0 THEN 'needs_clarification' ELSE 'ready' END AS status FROM e""",
    "stream_point_ingest": f"""
        SELECT CAST(floor(ts_us / 3600000000.0) * 3600000000 AS BIGINT) AS bucket_us, event_type, count(*) AS n
        FROM (SELECT DISTINCT user_id, ts_us, event_type, value FROM ({_EV})) GROUP BY 1, 2""",
    "folded_collision": """
        WITH n AS (SELECT DISTINCT 'stra' || CASE p_partkey % 3 WHEN 0 THEN 'ße' WHEN 1 THEN 'SSE' ELSE 'ze' END || CAST(floor(p_partkey / 6.0) AS BIGINT) AS name FROM part)
        SELECT replace(lower(name), 'ß', 'ss') AS folded, count(*) AS n FROM n GROUP BY 1 HAVING count(*) > 1""",
    "decoded_files": "SELECT doc_id, doc_id % 3 <> 2 AS valid, CASE WHEN doc_id % 3 <> 2 THEN sha256(text) END AS sha256 FROM documents",
    "entry_reconcile": """
        SELECT page_id, CASE page_id % 11 WHEN 1 THEN 'changed' WHEN 2 THEN 'changed' WHEN 3 THEN 'missing' WHEN 4 THEN 'extra' ELSE 'match' END AS status FROM pages""",
    "release_equality": """
        WITH k AS (SELECT page_id % 11 AS k FROM pages)
        SELECT count(*) FILTER (k <> 3) AS entries, count(*) FILTER (k <> 4) AS listed, count(*) FILTER (k = 1) AS changed, count(*) FILTER (k = 3) AS missing,
          count(*) FILTER (k = 4) AS extra, count(*) FILTER (k IN (1, 3, 4)) = 0 AS equal FROM k""",
    "manifest_round_trip": "SELECT 'nation/' || n_nationkey AS path, sha256(n_name) AS sha256, CAST(octet_length(encode(n_name)) AS BIGINT) AS bytes FROM nation",
    "file_rules": f"""
        WITH p AS (SELECT doc_id, 'k' AS kind, text FROM documents), {_HITS}
        SELECT doc_id, rule, CAST(place AS BIGINT) AS place FROM h
        UNION SELECT doc_id, 'authenticated_url', 4 FROM documents WHERE doc_id % 2 <> 0 AND doc_id % 3 = 0""",
    "strict_json_validity": """
        SELECT event_id, json_valid(CASE event_id % 7 WHEN 1 THEN props || ' x' WHEN 2 THEN props || ', 1' WHEN 3 THEN '' WHEN 4 THEN left(props, -1) || ', "k": 1, "k": "b"}'
          WHEN 5 THEN '[1 2]' ELSE props END) AS valid FROM events""",
    "branch_windows": """
        SELECT o_orderkey, CASE o_orderkey % 13 WHEN 5 THEN 'missing branch' WHEN 6 THEN 'missing branch' WHEN 1 THEN 'vehicle' WHEN 2 THEN 'start_us'
          WHEN 3 THEN 'end_us' WHEN 4 THEN 'env' ELSE 'same' END AS verdict FROM orders""",
    "task_sorted_points": f"SELECT user_id, ts_us, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS place FROM ({_EV})",
    "process_correlation": f"""
        WITH e AS (SELECT event_id % 2 AS source, user_id AS context, CAST(props->>'$.k' AS BIGINT) % 3 AS node, ts_us, event_id, event_type FROM ({_EV})),
        v AS (SELECT * FROM e WHERE event_type = 'view'),
        m AS (
          SELECT a.*, v.event_id AS view_id, v.ts_us AS v_us, row_number() OVER (PARTITION BY a.event_id ORDER BY v.ts_us DESC, v.event_id DESC) AS n
          FROM (SELECT * FROM e WHERE event_type = 'error') a
          LEFT JOIN v ON v.source = a.source AND v.context = a.context AND v.node = a.node AND v.ts_us <= a.ts_us)
        SELECT event_id, source, context, node, view_id, ts_us - v_us AS age_us FROM m WHERE n = 1""",
    "inference_latency": f"""
        SELECT event_id, end_us - ts_us AS latency_us FROM (
          SELECT *, lead(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS end_us FROM ({_EV})) WHERE event_type = 'view'""",
    "frame_gaps": f"""
        SELECT event_id, frame - last_frame - 1 AS lost FROM (
          SELECT *, lag(frame) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS last_frame
          FROM (SELECT *, CAST(floor(event_id / 40.0) AS BIGINT) AS frame FROM ({_EV}))) WHERE frame - last_frame > 1""",
    "message_routing": r"""
        SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'report' WHEN regexp_matches(text, '\?') THEN 'question'
          WHEN regexp_matches(text, '(?i)^[aeiou]') THEN 'followup' ELSE 'none' END AS task FROM conversations""",
    "serial_admission": f"""
        SELECT user_id, event_id, ts_us, round FROM (
          SELECT user_id, event_id, ts_us, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS round FROM ({_EV}) WHERE event_type = 'signup')
        ORDER BY round, ts_us, event_id LIMIT 1""",
    "signal_decode": f"WITH {_DECODED} SELECT event_id, message, signal, version, raw, CAST(raw AS DOUBLE) * 0.25 - 10.0 AS value, status FROM decoded",
    "signal_dictionary_check": f"""
        WITH {_DECODED}, c AS (SELECT signal, version, status, count(*) AS n FROM decoded WHERE signal IS NOT NULL GROUP BY ALL)
        SELECT d.signal, d.version, coalesce(c.status, 'never_met') AS status, coalesce(c.n, 0) AS n FROM dict d LEFT JOIN c USING (signal, version)""",
    "branch_barrier_stream": f"""
        WITH e AS (SELECT event_id // 2 AS job, event_id % 2 AS side, ts_us, value >= 8 AS ok FROM ({_EV})),
        a AS (SELECT * FROM e WHERE side = 0 AND job % 7 <> 4), b AS (SELECT * FROM e WHERE side = 1 AND job % 9 <> 4)
        SELECT coalesce(a.job, b.job) AS job, a.ts_us AS log_us, b.ts_us AS signal_us,
          CASE WHEN a.job IS NULL THEN CASE WHEN b.ok THEN 'log missing' ELSE 'log missing, signal failed' END
            WHEN b.job IS NULL THEN CASE WHEN a.ok THEN 'signal missing' ELSE 'log failed, signal missing' END
            WHEN a.ok AND b.ok THEN 'merge' WHEN a.ok THEN 'signal failed' WHEN b.ok THEN 'log failed' ELSE 'both failed' END AS verdict
        FROM a FULL JOIN b ON a.job = b.job AND abs(a.ts_us - b.ts_us) <= 3600000000""",
    "followup_stream": f"""
        WITH r AS (SELECT user_id, min(ts_us) AS reported FROM ({_EV}) WHERE event_type = 'signup' GROUP BY 1),
        q AS (
          SELECT user_id, event_id, greatest(ts_us, reported) AS ready, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k
          FROM ({_EV}) JOIN r USING (user_id) WHERE event_type = 'click'),
        o AS (SELECT *, k * 21600000000 + max(ready - k * 21600000000) OVER (PARTITION BY user_id ORDER BY k) AS opened_us FROM q)
        SELECT CAST(user_id AS VARCHAR) AS job, event_id AS seq, opened_us, opened_us + 21600000000 AS closed_us, 'expired' AS result FROM o""",
    "receipted_ingest": "SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users, CAST((SELECT count(*) FROM events) AS BIGINT) AS receipted FROM events GROUP BY 1",
    "file_selection": f"""
        WITH p AS (
          SELECT page_id, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/$', '/index') AS path FROM pages),
        n AS (SELECT *, regexp_extract(path, '^([^/]*/[^/]*)/', 1) AS folder FROM p)
        SELECT page_id, path, path <> '' AND (starts_with(path, 'de/') OR (folder <> '' AND {_ignores("folder")}) OR {_ignores("path")}) AS ignored FROM n""",
    "request_readings": f"""
        WITH e AS (SELECT *, 'DEM0VEH1CLE' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS car, strftime(ts, '%H:%M') || ' 至 ' || strftime(ts + INTERVAL 40 MINUTE, '%H:%M') AS span FROM ({_EV})),
        t AS (
          SELECT event_id, ts_us AS received_us, ts, CASE event_id % 6 WHEN 0 THEN '日志分析 ' || car || ' ' || strftime(ts, '%Y-%m-%d') || ' ' || span WHEN 1 THEN car || ' yesterday ' || span || ' UTC'
            WHEN 2 THEN car || ' ' || day(ts) || '/' || month(ts) || ' ' || span WHEN 3 THEN car || ' ' || span
            WHEN 4 THEN car || '，' || year(ts) || '年' || month(ts) || '月' || day(ts) || '日' || span ELSE car || ' DEM0VEH1CLEX00001 ' || strftime(ts, '%Y-%m-%d') || ' ' || span END AS raw_text FROM e),
        p AS (
          SELECT *, list_distinct(regexp_extract_all(raw_text, '[A-Z0-9]{{17}}')) AS cars, regexp_extract_all(raw_text, '([0-9]{{2}}):([0-9]{{2}})', 1) AS h, regexp_extract_all(raw_text, '([0-9]{{2}}):([0-9]{{2}})', 2) AS m,
            contains(raw_text, 'UTC') AS utc, CAST(ts + INTERVAL 8 HOUR AS DATE) AS here,
            CASE WHEN regexp_matches(raw_text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN [CAST(regexp_extract(raw_text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS DATE)]
              WHEN contains(raw_text, 'yesterday') THEN [CAST(ts AS DATE) - 1]
              WHEN contains(raw_text, '年') THEN [make_date(CAST(regexp_extract(raw_text, '([0-9]{{4}})年', 1) AS INT), CAST(regexp_extract(raw_text, '([0-9]+)月', 1) AS INT), CAST(regexp_extract(raw_text, '([0-9]+)日', 1) AS INT))]
              WHEN contains(raw_text, '/') THEN [TRY_CAST(y || '-' || lpad(regexp_extract(raw_text, '/([0-9]+)', 1), 2, '0') || '-' || lpad(regexp_extract(raw_text, '([0-9]+)/', 1), 2, '0') AS DATE) FOR y IN [2024, 2023]]
                || [TRY_CAST(y || '-' || lpad(regexp_extract(raw_text, '([0-9]+)/', 1), 2, '0') || '-' || lpad(regexp_extract(raw_text, '/([0-9]+)', 1), 2, '0') AS DATE) FOR y IN [2024, 2023]]
              ELSE [] END AS days,
            CASE WHEN regexp_matches(raw_text, '[0-9]{{4}}-') OR contains(raw_text, '年') THEN 'written date' WHEN contains(raw_text, 'yesterday') THEN 'relative day' ELSE 'day and month' END AS word FROM t),
        d AS (
          SELECT *, CASE WHEN contains(raw_text, '/') THEN list_distinct(list_filter([list_max(list_filter(days[1:2], lambda x: x <= here)), list_max(list_filter(days[3:4], lambda x: x <= here))], lambda x: x IS NOT NULL))
            ELSE days END AS met, (CAST(h[1] AS BIGINT) * 60 + CAST(m[1] AS BIGINT)) * 60000000 AS a, (CAST(h[2] AS BIGINT) * 60 + CAST(m[2] AS BIGINT)) * 60000000 AS z FROM p),
        s AS (
          SELECT *, CASE WHEN len(cars) > 1 THEN 'several_vehicles' WHEN len(days) = 0 THEN 'needs_date' WHEN len(met) > 1 THEN 'ambiguous' ELSE 'ready' END AS status,
            epoch_us(CAST(met[1] AS TIMESTAMP)) - CASE WHEN utc THEN 0 ELSE 28800000000 END AS base FROM d)
        SELECT event_id, raw_text, received_us, CASE WHEN len(cars) = 1 THEN cars[1] END AS vehicle, CASE WHEN status = 'ready' THEN base + a END AS start_us,
          CASE WHEN status = 'ready' THEN base + z + CASE WHEN z <= a THEN 86400000000 ELSE 0 END END AS end_us, CAST(len(met) AS INTEGER) AS readings, status,
          CASE WHEN status = 'ready' THEN word || CASE WHEN utc THEN '; zone written' ELSE '; zone Asia/Shanghai' END || CASE WHEN z <= a THEN '; ends next day' ELSE '' END END AS basis FROM s""",
    "rolling_latency": f"""
        WITH g AS (SELECT event_type, ts_us // 86400000000 AS span, ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS gap FROM ({_EV})),
        v AS (SELECT event_type, span, gap, greatest(length(bin(gap)) - 8, 0) AS s FROM g WHERE gap IS NOT NULL),
        m AS (SELECT d.event_type, d.span, ((v.gap >> v.s) << v.s) AS low FROM (SELECT DISTINCT event_type, span FROM v) d JOIN v ON v.event_type = d.event_type AND v.span BETWEEN d.span - 6 AND d.span),
        r AS (SELECT *, row_number() OVER (PARTITION BY event_type, span ORDER BY low) - 1 AS place, count(*) OVER (PARTITION BY event_type, span) AS n FROM m)
        SELECT event_type, span, n, max(low) FILTER (place = floor(0.5 * (n - 1))) AS p50_us, max(low) FILTER (place = floor(0.95 * (n - 1))) AS p95_us, max(low) FILTER (place = floor(0.99 * (n - 1))) AS p99_us
        FROM r GROUP BY ALL""",
}
