"""The derived tables once more, in the SQL of the oracle."""

DAY = "strftime(o_orderdate + INTERVAL ({}) DAY, '%Y-%m-%d')"
NOTICES = f"""notices AS (
    SELECT o_orderkey AS id,
        n_name || ' ' || c_mktsegment || ' ' || (year(o_orderdate) + 28)::VARCHAR || CASE WHEN o_orderkey % 5 <> 0 THEN ' recruitment notice' ELSE ' result list' END AS title,
        'https://n' || n_nationkey || '.example.org/info/' || o_custkey || '/' || o_orderkey || '.htm' AS url,
        n_name AS university, c_mktsegment AS college,
        CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'law' ELSE 'foreign_lang' END AS college_type,
        CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'ended' ELSE 'excellent_list' END AS status,
        CASE WHEN o_orderkey % 4 = 0 THEN 'pre' ELSE 'camp' END AS event_type,
        CASE WHEN o_orderkey % 7 <> 0 THEN {DAY.format(-30)} END AS publish_date,
        CASE o_orderkey % 6 WHEN 0 THEN {DAY.format(20)} || ' 18:30:00' WHEN 1 THEN {DAY.format(20)} || ' 09:15' WHEN 2 THEN {DAY.format(20)}
            WHEN 3 THEN strftime(o_orderdate + INTERVAL 20 DAY, '%Y-%-m-%-d') WHEN 4 THEN 'late July' END AS deadline,
        CASE WHEN o_orderkey % 6 IN (0) THEN date_trunc('day', o_orderdate + INTERVAL 20 DAY) + INTERVAL '18 hours 30 minutes' WHEN o_orderkey % 6 = 1 THEN date_trunc('day', o_orderdate + INTERVAL 20 DAY) + INTERVAL '9 hours 15 minutes'
            WHEN o_orderkey % 6 IN (2, 3) THEN date_trunc('day', o_orderdate + INTERVAL 20 DAY) END AS deadline_ts,
        CASE WHEN o_orderkey % 3 <> 0 THEN {DAY.format(40)} END AS event_time,
        CASE WHEN o_orderkey % 11 <> 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'online' WHEN 1 THEN 'offline' ELSE 'both' END END AS event_format,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN ' ' WHEN '2' THEN 'search' WHEN '3' THEN 'forum/law' WHEN '4' THEN 'my WeiXin feed' ELSE CASE WHEN o_orderkey % 9 = 0 THEN 'manual entry' ELSE 'submit form' END END AS source,
        CASE WHEN o_orderkey % 13 <> 0 THEN 'summary of ' || o_orderkey || CASE WHEN o_orderkey % 10 = 0 THEN chr(10) || '---more---' || chr(10) || 'quota: 5' ELSE '' END END AS summary,
        o_orderdate AS created_at, o_orderdate + to_seconds(o_orderkey % 1000) AS updated_at
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
labelled AS (
    SELECT *,
        CASE WHEN trim(source) = '' THEN 'official' WHEN source LIKE '%manual%' THEN 'manual' WHEN source LIKE '%submit%' THEN 'submit' WHEN trim(source) = 'search' THEN 'search'
            WHEN trim(source) LIKE 'messaging%' OR lower(source) LIKE '%weixin%' THEN 'messaging' WHEN trim(source) LIKE 'forum%' OR trim(source) LIKE 'board:%' THEN 'forum' ELSE 'official' END AS category,
        CASE WHEN status = 'excellent_list' THEN status WHEN deadline_ts < TIMESTAMP '1998-04-01' THEN 'ended' ELSE status END AS effective,
        CASE WHEN (title LIKE '%pre%' OR event_type = 'pre') AND (title LIKE '%result%' OR title LIKE '%outcome%') AND (title LIKE '%list%' OR title LIKE '%final%') THEN 'pre_result'
            WHEN title LIKE '%pre%' OR event_type = 'pre' THEN 'pre_notice' WHEN status = 'excellent_list' OR title LIKE '%result list%' OR title LIKE '%excellent%' THEN 'camp_result' ELSE 'camp_notice' END AS slot,
        (publish_date IS NOT NULL)::INT + (deadline IS NOT NULL)::INT + (event_time IS NOT NULL)::INT + (event_format IS NOT NULL)::INT AS filled
    FROM notices)"""
DIRECTORY = """directory AS (
    SELECT c_custkey AS ord, n_name AS university, c_mktsegment AS college, CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'law' ELSE 'foreign_lang' END AS college_type, n_name AS province, r_name AS region,
        CASE c_custkey % 4 WHEN 0 THEN ['985', '211', 'dual'] WHEN 1 THEN ['211', 'dual'] WHEN 2 THEN ['dual'] ELSE []::VARCHAR[] END AS tags,
        CASE c_custkey % 4 WHEN 0 THEN '985' WHEN 1 THEN '211' WHEN 2 THEN 'dual' END AS tier
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
TARGETS = """targets AS (
    SELECT min(c_custkey) AS ord, n_name AS university, c_mktsegment AS college, CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'law' ELSE 'foreign_lang' END AS college_type,
        CASE WHEN n_nationkey % 9 = 0 THEN '' ELSE 'https://n' || n_nationkey || '.example.org' END AS base_url
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name, c_mktsegment)"""
RUNS = """runs AS (
    SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'summer_camp' ELSE 'pre_admission' END AS board, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'running' ELSE 'success' END AS status, ts AS started_at,
        CASE WHEN event_type <> 'signup' THEN ts + to_seconds(floor(value)::INT) END AS finished_at, CASE WHEN event_type = 'click' THEN floor(value)::BIGINT ELSE 0 END AS found FROM events)"""
FAILS = """fails AS (
    SELECT event_id, ts, user_id AS ann_id, CASE WHEN event_type IN ('click', 'error') THEN 'fail' WHEN event_type = 'purchase' THEN 'success' WHEN event_type = 'signup' THEN 'clear' ELSE 'fail' END AS op,
        CASE WHEN event_type = 'error' THEN 'no_content' WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'http' END AS failure_type FROM events)"""


def sql(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {body}"
