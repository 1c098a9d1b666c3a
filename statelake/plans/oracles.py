"""The same results in DuckDB SQL over the same tables, for checking the registered queries."""

from __future__ import annotations

from statelake.plans.registry import CURVE_BOUNDS, PASSTHROUGH

EVENTS = """(
SELECT CASE WHEN event_type = 'purchase' THEN 'tx' ELSE 'state_diff' END AS type,
  '0x' || sha1('A' || user_id) AS address, '0x' || sha256('K' || user_id) AS key,
  '0x' || sha256('V' || event_id) AS value, '0x' || sha256('T' || event_id) AS tx_hash,
  b AS blob_index, event_id AS position, 1704067200 + 345600 * ((b - 1) // 4) AS timestamp
FROM (SELECT *, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS BIGINT) AS b FROM events)
)"""
ORDERS = """(
SELECT 'state_diff' AS type, '0x' || sha1('A' || o_custkey) AS address, '0x' || sha256('K' || o_custkey) AS key,
  '0x' || sha256('V' || o_orderkey) AS value, '0x' || sha256('T' || o_orderkey) AS tx_hash,
  b AS blob_index, o_orderkey AS position, 788918400 + (b - 1) * 86400 AS timestamp
FROM (SELECT *, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS BIGINT) AS b FROM orders)
)"""
DIFFS = """(
SELECT '0x' || lower(to_hex(l_suppkey)) AS address, '0x' || lower(to_hex(l_partkey)) AS key,
  '0x' || lower(to_hex(CAST(l_quantity AS BIGINT))) AS value, 'lineitem' AS src FROM lineitem)"""
DEPLOYED = """(
SELECT '0x' || lower(to_hex(c_custkey)) AS address, '0x' || sha256(c_mktsegment) AS class_hash FROM customer)"""
WALLETS = """(
SELECT '0x' || sha256(s) AS class_hash, w AS wallet FROM (VALUES ('BUILDING', 'Wallet A'), ('AUTOMOBILE', 'Wallet B'),
  ('FURNITURE', 'Wallet C'), ('HOUSEHOLD', 'Wallet C')) AS t(s, w))"""
NONCES = """(
SELECT '0x' || lower(to_hex(conv_id)) AS contract_address, '0x' || lower(to_hex(turn * 5)) AS nonce FROM conversations)"""
ITEMS = """(
SELECT conv_id AS eth_block, '0x' || sha256('T' || conv_id) AS tx_hash, turn AS idx, 'blob-' || conv_id || '-' || turn AS path
FROM conversations WHERE (conv_id * 7 + turn) % 11 <> 0)"""
COMPLETE = f"""(
SELECT eth_block, tx_hash, idx, path FROM {ITEMS} WHERE (eth_block, tx_hash) IN (
  SELECT (eth_block, tx_hash) FROM {ITEMS} GROUP BY eth_block, tx_hash
  HAVING count(*) = max(idx) + 1 AND count(DISTINCT idx) = count(*) AND min(idx) = 0))"""
USER_EVENTS = """(
SELECT event_id, event_type, value, CASE WHEN user_id % 50 = 7 THEN NULL WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS k,
  CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS BIGINT) AS t FROM events)"""
OPEN_ORDERS = """(
SELECT CASE WHEN o_custkey % 40 = 3 THEN NULL ELSE o_custkey END AS k, o_orderkey AS o,
  date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS s,
  CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) + pow(o_orderkey % 7, 3) - 1 AS BIGINT) AS e FROM orders)"""
COLUMNS = "type, address, key, value, tx_hash, blob_index, position, timestamp"
LATEST = "timestamp DESC, blob_index DESC, position DESC, tx_hash DESC, value DESC"


def _lww(source: str, where: str = "true", keys: str = "key") -> str:
    return (
        f"SELECT {COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {LATEST}) AS rn "
        f"FROM {source} WHERE {where}) WHERE rn = 1"
    )


def _edge(window: int) -> str:
    return f"(SELECT max(blob_index) - {window} FROM {EVENTS})"


def _live_count(window: int) -> str:
    return f"""
WITH old AS ({_lww(EVENTS, f"blob_index <= {_edge(window)}")}), fresh AS ({_lww(EVENTS, f"blob_index > {_edge(window)}")})
SELECT (SELECT count(*) FROM old) + (SELECT count(*) FROM fresh WHERE NOT EXISTS (
  SELECT 1 FROM old WHERE old.key = fresh.key AND (old.timestamp, old.blob_index, old.position)
    >= (fresh.timestamp, fresh.blob_index, fresh.position))) AS keys"""


ITEM_FIELDS = """(
SELECT CASE WHEN conv_id % 3 < 2 THEN conv_id ELSE 0 END AS eth_block, 't' || conv_id AS tx_hash, turn AS idx,
  CASE turn % 4 WHEN 0 THEN 1700000000 + conv_id WHEN 1 THEN 1704164645 WHEN 2 THEN 1704161045 END AS timestamp,
  turn % 4 = 3 AS timestamp_missing,
  CASE turn % 5 WHEN 0 THEN 'u' || conv_id WHEN 1 THEN 'v' || conv_id WHEN 2 THEN 'w' || conv_id ELSE 'z' END AS url
FROM conversations WHERE turn % 5 < 4)"""
CATALOG = """(
SELECT page_id, ['arrow', 'parquet', 'files', 'urls'][page_id % 4 + 1] AS kind,
  'data/' || (page_id // 8) || '.bin' AS path, page_id AS ord FROM pages)"""
MERGED = f"""(
SELECT kind, path, min(ord) AS ord FROM (
  SELECT kind, path, ord FROM {CATALOG} WHERE page_id % 3 <> 0
  UNION ALL
  SELECT r.kind, path, ord + coalesce(high, 0) AS ord FROM {CATALOG} r LEFT JOIN (
    SELECT kind, max(ord) + 1 AS high FROM {CATALOG} WHERE page_id % 3 <> 0 GROUP BY kind) m ON m.kind = r.kind
  WHERE page_id % 2 = 0 OR page_id % 3 = 0) GROUP BY kind, path)"""
SEGMENTS = """(
SELECT *, CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END AS side,
  coalesce(nullif(file, ''), nullif(path, ''), nullif(url, '')) AS k FROM (
  SELECT page_id, page_id AS ord,
    CASE page_id % 4 WHEN 0 THEN 'f' || (page_id // 16) WHEN 1 THEN '' END AS file,
    CASE page_id % 4 WHEN 1 THEN 'f' || (page_id // 16) END AS path,
    CASE page_id % 4 WHEN 2 THEN 'u' || (page_id // 8) END AS url FROM pages))"""
MERGED_SEGMENTS = f"""(
SELECT file, path, url, CAST(first.side AS INTEGER) AS side, first.ord AS ord FROM (
  SELECT *, row_number() OVER (PARTITION BY coalesce(k, 'own ' || page_id) ORDER BY side DESC, ord DESC) AS rn,
    min({{'side': side, 'ord': ord}}) OVER (PARTITION BY coalesce(k, 'own ' || page_id)) AS first FROM {SEGMENTS}) WHERE rn = 1)"""
OVERLAY = """(
SELECT c_custkey AS ord, c_custkey % 11 <> 0 AS prefixed, '0x' || sha256(c_mktsegment || (c_nationkey % 3)) AS class_hash,
  CASE WHEN c_custkey % 4 >= 2 THEN 'W' || c_custkey END AS wallet FROM customer)"""

ORACLES: dict[str, str] = {
    "lww_events": _lww(EVENTS),
    "lww_orders": _lww(ORDERS),
    "lww_max_by_events": _lww(EVENTS),
    "lww_address_and_key": _lww(EVENTS, keys="address, key, type"),
    "lww_filtered": _lww(ORDERS, "timestamp BETWEEN 789264000 AND 793584000 AND blob_index BETWEEN 5 AND 50"),
    "asof_blob_index": _lww(EVENTS, "blob_index <= 10"),
    "asof_timestamp": _lww(ORDERS, "timestamp <= 791510400"),
    "split_base_count_w4": f"""
SELECT 'base' AS part, count(DISTINCT key) AS rows FROM {EVENTS} WHERE blob_index <= {_edge(4)}
UNION ALL SELECT 'recent', count(*) FROM {EVENTS} WHERE blob_index > {_edge(4)}""",
    "delta_winners_w4": _lww(EVENTS, f"blob_index > {_edge(4)}"),
    **{f"live_count_as_written_w{w}": _live_count(w) for w in (1, 4, 16)},
    **{f"live_view_w{w}": _lww(EVENTS) for w in (1, 4, 16)},
    "global_last": f"SELECT value, timestamp FROM {EVENTS} ORDER BY {LATEST} LIMIT 1",
    "lww_key_count": f"SELECT count(DISTINCT key) AS unique_keys FROM {ORDERS}",
    "last_ts_per_key": f"SELECT key, max(timestamp) AS ts FROM {ORDERS} GROUP BY key",
    "snapshot_duplicates": f"SELECT key, count(*) AS n, 'raw' AS part FROM {ORDERS} GROUP BY key HAVING count(*) > 1",
    "upsert_orders": _lww(ORDERS),
    "delta_versions_orders": _lww(ORDERS),
    "snapshot_version_read": _lww(ORDERS, "blob_index <= 30"),
    "blob_decode_roundtrip": f"SELECT {COLUMNS} FROM {EVENTS}",
    "curve_layout_read": " UNION ALL ".join(
        "SELECT '" + bound.replace("'", "''") + f"' AS bound, count(*) AS rows, max(key) AS key FROM {ORDERS} WHERE {bound} HAVING count(*) > 0"
        for bound in CURVE_BOUNDS
    ),
    "blob_members_read": f"SELECT {COLUMNS} FROM {EVENTS}",
    "blob_files_by_name": f"""
SELECT blob_index, count(*) AS rows, max(position) AS last FROM {EVENTS}
WHERE blob_index BETWEEN 3 AND 20 GROUP BY blob_index""",
    "blob_file_report": f"SELECT blob_index, count(*) AS rows, true AS ok FROM {EVENTS} GROUP BY blob_index",
    "blob_words": """
WITH w AS (SELECT CAST(i AS INTEGER) AS position, sha256(s_suppkey || '-' || i) AS h FROM supplier, range(4096) AS r(i)),
b AS (SELECT position, h, array_to_string([substr(h, CAST(63 - 2 * j AS BIGINT), 2) FOR j IN range(32)], '') AS r FROM w)
SELECT position, '0x' || max(h) AS greatest, '0x' || max(r) AS greatest_le FROM b GROUP BY position""",
    "word_state_last": """
SELECT '0x' || sha256(s_suppkey || '-4095') AS value, CAST(1700000000 AS BIGINT) AS timestamp, s_suppkey AS blob_index,
  CAST(4095 AS BIGINT) AS position FROM supplier ORDER BY s_suppkey DESC LIMIT 1""",
    "arrow_scan": f"SELECT {COLUMNS} FROM {ORDERS}",
    "partition_columns": f"""
SELECT CAST(167001 AS BIGINT) AS chain_id, CAST(timestamp // 86400 AS INTEGER) AS date, type AS topic, count(*) AS rows,
  CAST(min(DATE '1970-01-01' + CAST(timestamp // 86400 AS INTEGER)) AS VARCHAR)[1:10] AS day
FROM {EVENTS} GROUP BY ALL""",
    "partitioned_write_read": f"""
SELECT {COLUMNS}, CAST(5 AS BIGINT) AS chain_id, CAST(timestamp // 86400 AS INTEGER) AS date, type AS topic
FROM {ORDERS}""",
    "partitioned_pruned_read": f"""
SELECT {COLUMNS}, CAST(5 AS BIGINT) AS chain_id, CAST(timestamp // 86400 AS INTEGER) AS date, type AS topic
FROM {ORDERS} WHERE timestamp // 86400 >= 9140""",
    "state_union": f"SELECT blob_index, count(*) AS rows, max(key) AS key FROM {ORDERS} GROUP BY blob_index",
    "norm_hex_parts": """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '0x' || lower(to_hex(p_partkey)) WHEN 1 THEN '0X0' || to_hex(p_partkey)
  WHEN 2 THEN '0x0' WHEN 3 THEN CAST(p_partkey AS VARCHAR) END AS norm FROM part""",
    "to_hex_customers": "SELECT c_custkey, '0x' || sha1('A' || c_custkey) AS address FROM customer",
    "short_hex_parts": """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '0x' || lower(hex(encode(p_brand)))
  ELSE '0x' || substr(sha256(p_name), 1, 32) || '…' END AS shown FROM part""",
    "epoch_functions": """
SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day_no,
  strftime(o_orderdate, '%Y-%m-%d') AS day,
  date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400 + 9 AS iso_s FROM orders""",
    "path_functions": """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'https://lake.example/data/x/' || page_id || '.ARROW'
  ELSE 'https://lake.example/data/y/p_' || page_id END AS full,
  CASE page_id % 3 WHEN 1 THEN '.arrow' WHEN 2 THEN '.bin' ELSE lower(coalesce(nullif(regexp_extract(
    regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '[^./][^/]*(\\.[^./]*)$', 1), ''), '.bin')) END AS ext FROM pages""",
    "flatten_storage_diffs": """
SELECT address, key, value, 'lineitem' AS src, count(*) AS n FROM (
  SELECT '0x' || lower(to_hex(l_suppkey)) AS address, '0x' || lower(to_hex(l_partkey)) AS key,
    CASE WHEN CAST(l_quantity AS BIGINT) = 0 THEN '0x0' ELSE '0x' || lower(to_hex(CAST(l_quantity AS BIGINT))) END AS value
  FROM lineitem WHERE l_linenumber <> 7
  UNION ALL
  SELECT '0x' || lower(to_hex(l_suppkey)), CASE WHEN l_orderkey = 0 THEN '0x0' ELSE '0x' || lower(to_hex(l_orderkey)) END, '0x0'
  FROM lineitem WHERE l_linenumber <> 7) GROUP BY address, key, value""",
    "flatten_nonces": """
SELECT CASE WHEN conv_id = 0 THEN '0x0' ELSE '0x' || lower(to_hex(conv_id)) END AS contract_address,
  CASE WHEN turn = 0 THEN '0x0' ELSE '0x' || lower(to_hex(turn * 5)) END AS nonce, 'conversations' AS src FROM conversations""",
    "flatten_declared": """
SELECT '0x' || ltrim(sha256(p_name), '0') AS class_hash, CAST(p_partkey AS VARCHAR) AS compiled_class_hash, 'part' AS src FROM part""",
    "flatten_deployed": """
SELECT CASE WHEN c_custkey = 0 THEN '0x0' ELSE '0x' || lower(to_hex(c_custkey)) END AS address, '0xa' AS class_hash, 'customer' AS src
FROM customer UNION ALL SELECT '0x1', c_mktsegment, 'customer' FROM customer""",
    "flatten_contracts": """
SELECT addr, key, value, class_hash, nonce FROM (
  SELECT CAST(o_custkey AS VARCHAR) AS addr, CAST(o_orderkey AS VARCHAR) AS key, '9' AS value,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS class_hash, CASE WHEN o_orderkey % 2 = 0 THEN '7' END AS nonce
  FROM orders UNION ALL
  SELECT CAST(o_custkey AS VARCHAR), CAST(o_orderkey * 2 AS VARCHAR), CAST(o_custkey AS VARCHAR),
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) END, CASE WHEN o_orderkey % 2 = 0 THEN '7' END FROM orders)""",
    "index_resolve": """
SELECT CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) WHEN c_custkey IS NOT NULL
    THEN CAST(c_custkey * 1000 AS VARCHAR) ELSE '9' || lpad(CAST(o_custkey AS VARCHAR), 39, '0') END AS addr,
  CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS value
FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = o_custkey""",
    "json_lines_write_read": """
SELECT class_hash, nonce, count(*) AS n, max(key) AS key FROM (
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS class_hash,
    CASE WHEN o_orderkey % 2 = 0 THEN '7' END AS nonce, CAST(o_orderkey * f AS VARCHAR) AS key
  FROM orders, (VALUES (1), (2)) AS t(f)) GROUP BY class_hash, nonce""",
    "diff_store_ingest": """
SELECT c_mktsegment AS item, count(*) AS n FROM customer GROUP BY 1 UNION ALL
SELECT CASE WHEN turn = 0 THEN '0x0' ELSE '0x' || lower(to_hex(turn)) END, count(*) FROM conversations GROUP BY 1""",
    "complete_sets": f"SELECT * FROM {COMPLETE}",
    "manifest_entries": f"""
        SELECT eth_block, tx_hash, row_number() OVER (PARTITION BY eth_block, tx_hash ORDER BY idx) - 1 AS position, path
        FROM {COMPLETE}""",
    "incremental_new_files": "SELECT 'd' || doc_id || '.json' AS name, sha1(text) AS sha1 FROM documents WHERE doc_id % 3 <> 2",
    "file_content_digests": """
SELECT c_nationkey AS nation, sha1(string_agg(c_name || chr(10), '' ORDER BY c_custkey)) AS sha1 FROM customer GROUP BY c_nationkey""",
    "generated_hot_keys": """
WITH share AS (SELECT 20 AS hot, CAST(floor(20.0 * 20 / (20.0 * 20 + 380) * 1000000) AS BIGINT) AS of_million),
n AS (SELECT event_id AS id, CASE WHEN ('0x' || substr(md5('side3-' || event_id), 1, 15))::BIGINT % 1000000 < of_million
    THEN ('0x' || substr(md5('hot3-' || event_id), 1, 15))::BIGINT % hot
    ELSE hot + ('0x' || substr(md5('cold3-' || event_id), 1, 15))::BIGINT % 380 END AS k FROM events, share)
SELECT '0x' || sha256('K' || k) AS key, '0x' || sha1('A' || k) AS address, count(*) AS rows, max(id // 1000 + 1) AS last_blob,
  arg_max('0x' || sha256('V3-' || id), id) AS value FROM n GROUP BY k""",
    "files_without_output": "SELECT 'raw/blob_' || page_id || '.blob.gz' AS path FROM pages WHERE page_id % 2 <> 0",
    "blob_item_rows": f"SELECT * FROM {ITEM_FIELDS}",
    "blob_page": f"""
SELECT * FROM {ITEM_FIELDS} WHERE eth_block BETWEEN 5 AND 60
ORDER BY eth_block DESC, idx DESC, tx_hash DESC, url DESC LIMIT 12 OFFSET 15""",
    "wallet_share": f"""
SELECT wallet, count(*) AS cnt FROM {DEPLOYED} JOIN {WALLETS} USING (class_hash)
GROUP BY wallet ORDER BY cnt DESC, wallet LIMIT 12""",
    "wallet_map_overlay": f"""
WITH entries AS (
  SELECT DISTINCT class_hash, 'seed' AS wallet, 0 AS side, CAST(0 AS BIGINT) AS ord FROM {OVERLAY} WHERE prefixed
  UNION ALL SELECT class_hash, wallet, 0, 0 FROM {WALLETS}
  UNION ALL SELECT class_hash, wallet, 1, ord FROM {OVERLAY} WHERE prefixed AND wallet IS NOT NULL)
SELECT class_hash, wallet FROM (SELECT *, row_number() OVER (PARTITION BY class_hash ORDER BY side DESC, ord DESC, wallet DESC) AS rn
  FROM entries) WHERE rn = 1""",
    "share_of_total": f"""
SELECT wallet, cnt, round(CAST(cnt AS DOUBLE) * 100 / sum(cnt) OVER (), 6) AS pct FROM (
  SELECT wallet, count(*) AS cnt FROM {DEPLOYED} JOIN {WALLETS} USING (class_hash)
  GROUP BY wallet ORDER BY cnt DESC, wallet LIMIT 12)""",
    "top_writers": f"""
SELECT address, count(*) AS writes FROM {DIFFS} WHERE address IS NOT NULL AND lower(address) <> '0x1'
GROUP BY address ORDER BY writes DESC, address LIMIT 20""",
    "class_ranking": f"SELECT class_hash, count(*) AS cnt FROM {DEPLOYED} GROUP BY class_hash ORDER BY cnt DESC, class_hash LIMIT 20",
    "value_ranking": f"SELECT value, count(*) AS c FROM {DIFFS} GROUP BY value ORDER BY c DESC, value LIMIT 10",
    "latest_nonce_text": f"""
SELECT contract_address, max(nonce) AS latest_nonce FROM {NONCES} GROUP BY contract_address
ORDER BY contract_address NULLS LAST LIMIT 50""",
    "latest_nonce_numeric": """
SELECT '0x' || lower(to_hex(conv_id)) AS contract_address,
  CASE WHEN max(turn) = 0 THEN '0x0' ELSE '0x' || lower(to_hex(max(turn) * 5)) END AS latest_nonce
FROM conversations GROUP BY conv_id""",
    "nonces_listing": f"SELECT contract_address, nonce FROM {NONCES} ORDER BY contract_address, nonce LIMIT 50",
    "catalog_merge": f"SELECT * FROM {MERGED}",
    "catalog_delta": f"""
SELECT k AS kind, CAST(coalesce(a.n, 0) - coalesce(b.n, 0) AS BIGINT) AS added
FROM (VALUES ('arrow'), ('parquet'), ('files'), ('segments')) AS t(k)
LEFT JOIN (SELECT kind, count(*) AS n FROM {MERGED} GROUP BY kind UNION ALL SELECT 'segments', count(*) FROM {MERGED_SEGMENTS}) a
  ON a.kind = k
LEFT JOIN (SELECT kind, count(*) AS n FROM {CATALOG} WHERE page_id % 3 <> 0 GROUP BY kind
  UNION ALL SELECT 'segments', count(*) FROM pages WHERE page_id % 3 = 0) b ON b.kind = k""",
    "catalog_segments": f"SELECT * FROM {MERGED_SEGMENTS}",
    "catalog_absolute": """
SELECT kind, path, min(page_id) AS ord, 'https://lake.example/data' AS base FROM (
  SELECT page_id, ['arrow', 'parquet', 'files', 'urls'][page_id % 4 + 1] AS kind,
    CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://lake.example/data/' || (page_id // 4) END AS path FROM pages)
GROUP BY kind, path""",
    "catalog_remap": """
SELECT ['arrow', 'parquet', 'files', 'urls'][p.page_id % 4 + 1] AS kind,
  CASE WHEN (p.page_id // 2) % 3 = 0 AND p.page_id % 4 <> 3 THEN 'objects/' || (p.page_id // 2) ELSE 'p' || (p.page_id // 2) END AS path,
  p.page_id AS ord FROM pages p""",
    "segments_absolute_remap": f"""
SELECT CASE WHEN page_id % 4 = 0 THEN CASE WHEN (page_id // 16) % 3 = 0 THEN 'objects/' || (page_id // 16)
    ELSE 'https://lake.example/data/f' || (page_id // 16) END
  WHEN page_id % 4 = 1 THEN 'https://lake.example/data/' END AS file, path, url, ord FROM {SEGMENTS} WHERE page_id % 3 <> 0""",
    "manifest_write_read": f"""
SELECT kind, path, row_number() OVER (PARTITION BY kind ORDER BY ord, path) - 1 AS ord, 'https://lake.example/data' AS base FROM {MERGED}
UNION ALL
SELECT 'segments', coalesce('file:' || file, 'path:' || path, 'url:' || url), row_number() OVER (ORDER BY side, ord) - 1,
  'https://lake.example/data' FROM {MERGED_SEGMENTS}""",
    "catalog_to_views": f"""
SELECT address AS name, count(*) AS n FROM {DIFFS} GROUP BY address
UNION ALL SELECT contract_address, count(*) FROM {NONCES} GROUP BY contract_address""",
    "preferred_files": f"""
SELECT blob_index, count(*) AS rows, max(key) AS key FROM (
  SELECT blob_index, key FROM {ORDERS} UNION ALL SELECT blob_index, key FROM {EVENTS}) GROUP BY blob_index""",
    "empty_table": f"SELECT {COLUMNS} FROM {ORDERS}",
    "result_envelope": f"""
SELECT blob_index, key, CAST(count(*) OVER () AS BIGINT) AS row_count, true AS complete
FROM (SELECT blob_index, max(key) AS key FROM {EVENTS} GROUP BY blob_index)""",
    "bad_blobs_left_out": f"""
SELECT blob_index, count(*) AS rows, max(position) AS last, true AS ok FROM {EVENTS} GROUP BY blob_index
UNION ALL SELECT blob_index, NULL, NULL, false FROM {EVENTS} WHERE blob_index % 3 = 0 GROUP BY blob_index""",
    "catalog_fallback": f"SELECT 'storage_diffs' AS kind, path, ord FROM {CATALOG} WHERE page_id % 3 <> 0 AND kind = 'parquet'",
    "catalog_build": "SELECT DISTINCT 'parquet' AS kind, lang FROM documents",
    "registered_tables": """
SELECT 'storage_diffs' AS name, count(*) AS n, count(*) AS with_src FROM lineitem UNION ALL
SELECT 'nonces', count(*), count(*) FROM conversations UNION ALL
SELECT 'declared_classes', 0, 0 UNION ALL SELECT 'deployed_or_replaced', 0, 0""",
    "asof_join_events": f"""
SELECT l.event_id, l.k, l.t, r.seen_t, r.seen_id, r.seen_value FROM (SELECT * FROM {USER_EVENTS} WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT k, t AS seen_t, max(event_id) AS seen_id, arg_max(value, event_id) AS seen_value FROM {USER_EVENTS}
  WHERE event_type IN ('view', 'click') GROUP BY k, t) r ON l.k = r.k AND l.t >= r.seen_t""",
    "asof_join_next_error": f"""
SELECT l.event_id, l.k, l.t, CASE WHEN r.error_t - l.t <= 48 THEN r.error_t END AS error_t,
  CASE WHEN r.error_t - l.t <= 48 THEN r.error_id END AS error_id
FROM (SELECT * FROM {USER_EVENTS} WHERE event_type = 'signup') l
ASOF LEFT JOIN (SELECT k, t AS error_t, min(event_id) AS error_id FROM {USER_EVENTS} WHERE event_type = 'error' GROUP BY k, t) r
  ON l.k = r.k AND l.t < r.error_t""",
    "overlapping_orders": f"""
SELECT l.k, l.o AS a, l.s AS a_start, l.e AS a_end, r.o AS b, r.s AS b_start, r.e AS b_end
FROM {OPEN_ORDERS} l JOIN {OPEN_ORDERS} r ON l.k = r.k AND l.o < r.o AND l.s <= r.e AND r.s <= l.e
WHERE l.s <= l.e AND r.s <= r.e""",
    "events_in_windows": """
SELECT event_id, s_suppkey AS window FROM events JOIN (SELECT s_suppkey,
    TIMESTAMP '2024-01-01' + to_hours(CAST(s_suppkey * 7 % 720 AS INTEGER)) AS lo,
    CASE WHEN s_suppkey % 500 = 0 THEN 43200 ELSE CAST(pow(s_suppkey % 5, 4) AS INTEGER) END AS minutes FROM supplier)
  ON ts BETWEEN lo AND lo + to_minutes(minutes)""",
    "stream_lww_events": _lww(EVENTS),
    "stream_late_data": _lww(EVENTS),
    "stream_blob_source": _lww(EVENTS),
    "blob_source_sql": f"""
SELECT blob_index, count(*) AS rows, max(position) AS last, max(key) AS key FROM {EVENTS}
WHERE blob_index BETWEEN 3 AND 20 AND timestamp >= 1704067200 + 345600 AND type = 'state_diff' GROUP BY blob_index""",
    "arrow_source_sql": f"SELECT {COLUMNS} FROM {ORDERS} WHERE blob_index > 40 AND position % 3 = 0",
    "stream_keyed_changes": f"SELECT * FROM ({_lww(EVENTS)}) WHERE blob_index > 5",
    "snapshot_key_sketches": f"""
SELECT v.version, CASE v.version WHEN 1 THEN (SELECT count(DISTINCT key) FROM {ORDERS} WHERE blob_index <= 30)
  ELSE (SELECT count(DISTINCT key) FROM {ORDERS}) END AS keys, v.version <> 2 AS exact, true AS near, true AS middle_in_range
FROM (VALUES (1), (2), (3)) AS v(version)""",
    "snapshot_live_count": f"SELECT count(DISTINCT key) AS keys FROM {ORDERS}",
    "snapshot_changes": f"""
WITH a AS ({_lww(ORDERS, "blob_index <= 40 AND position % 5 <> 0")}),
b AS ({_lww(ORDERS, "blob_index <= 60 OR position % 5 = 0")})
SELECT CASE WHEN a.key IS NULL THEN 'insert' ELSE 'update' END AS change, b.key, a.value AS old_value, b.value AS new_value
FROM b LEFT JOIN a ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value""",
    "history_as_of": _lww(EVENTS, "blob_index <= 12"),
    "history_intervals": f"""
SELECT key, position, blob_index, lead(blob_index) OVER (PARTITION BY key ORDER BY blob_index, position) AS valid_to FROM {EVENTS}""",
    "stream_catch_up": f"SELECT {COLUMNS}, CAST(7 AS BIGINT) AS chain_id, CAST(timestamp // 86400 AS INTEGER) AS date FROM {EVENTS}",
    **{name: text.replace("left semi join", "semi join") for name, text in PASSTHROUGH.items()},
}
