"""The registered queries again, in plain SQL and by other means, for comparison.

The funnel is chained minimum joins here, merging is done by looking for uncovered ends, weekly
hours are counted cell by cell, and tag matches are made pair by pair.
"""

from __future__ import annotations

_TIME = "'%Y-%m-%d %H:%M:%S.%f'"



def _cents(name: str) -> str:
    return f"CAST(round({name} * 100) AS BIGINT)"


_INT, _TEXT, _MONEY, _TIME_KIND, _VECTOR = "int", "text", "money", "time", "vector"

_COLUMNS = {
    "region": {"r_regionkey": _INT, "r_name": _TEXT},
    "nation": {"n_nationkey": _INT, "n_name": _TEXT, "n_regionkey": _INT},
    "customer": {"c_custkey": _INT, "c_name": _TEXT, "c_nationkey": _INT, "c_acctbal": _MONEY,
                 "c_mktsegment": _TEXT},
    "supplier": {"s_suppkey": _INT, "s_name": _TEXT, "s_nationkey": _INT, "s_acctbal": _MONEY},
    "part": {"p_partkey": _INT, "p_name": _TEXT, "p_brand": _TEXT, "p_type": _TEXT,
             "p_size": _INT, "p_retailprice": _MONEY},
    "orders": {"o_orderkey": _INT, "o_custkey": _INT, "o_orderstatus": _TEXT,
               "o_totalprice": _MONEY, "o_orderdate": _TIME_KIND, "o_orderpriority": _TEXT},
    "lineitem": {"l_orderkey": _INT, "l_partkey": _INT, "l_suppkey": _INT, "l_linenumber": _INT,
                 "l_quantity": _MONEY, "l_extendedprice": _MONEY, "l_discount": _MONEY,
                 "l_tax": _MONEY, "l_returnflag": _TEXT, "l_linestatus": _TEXT,
                 "l_shipdate": _TIME_KIND},
    "events": {"event_id": _INT, "ts": _TIME_KIND, "user_id": _INT, "event_type": _TEXT,
               "value": _MONEY, "props": _TEXT},
    "documents": {"doc_id": _INT, "text": _TEXT, "lang": _TEXT, "source": _TEXT, "n_chars": _INT},
    "embeddings": {"vec_id": _INT, "embedding": _VECTOR, "label": _INT},
    "pages": {"page_id": _INT, "url": _TEXT, "html": _TEXT},
    "benchmark": {"item_id": _INT, "text": _TEXT},
    "labels": {"doc_id": _INT, "quality": _INT, "toxic": _INT},
    "conversations": {"conv_id": _INT, "turn": _INT, "role": _TEXT, "text": _TEXT},
}

_DIGESTS = {
    _INT: "CAST({0} AS BIGINT)",
    _TEXT: "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)",
    _MONEY: "CAST(round({0} * 100) AS BIGINT)",
    _TIME_KIND: "CAST(floor(epoch({0})) AS BIGINT)",
    _VECTOR: "list_sum(list_transform({0}, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)))",
}


def _table_check(name: str) -> str:
    columns = _COLUMNS[name]
    nulls = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in columns)
    digests = " + ".join(
        f"coalesce({_DIGESTS[kind].format(c)}, 0)" for c, kind in columns.items()
    )
    return f"""
SELECT '{name}' AS table_name, count(*) AS n, CAST(coalesce(sum({nulls}), 0) AS BIGINT) AS nulls,
       CAST(coalesce(sum({digests}), 0) AS BIGINT) AS checksum
FROM {name}"""


_FUNNEL = """
e AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_type FROM events),
s1 AS (SELECT user_id, day, min(ts) AS t FROM e WHERE event_type = 'view' GROUP BY ALL),
s2 AS (SELECT e.user_id, e.day, min(e.ts) AS t FROM e JOIN s1 USING (user_id, day)
       WHERE event_type = 'click' AND e.ts > s1.t GROUP BY ALL),
s3 AS (SELECT e.user_id, e.day, min(e.ts) AS t FROM e JOIN s2 USING (user_id, day)
       WHERE event_type = 'signup' AND e.ts > s2.t GROUP BY ALL),
s4 AS (SELECT e.user_id, e.day, min(e.ts) AS t FROM e JOIN s3 USING (user_id, day)
       WHERE event_type = 'purchase' AND e.ts > s3.t GROUP BY ALL),
reached AS (
  SELECT 1 AS stage, 'view' AS event_type, user_id FROM s1
  UNION ALL SELECT 2, 'click', user_id FROM s2
  UNION ALL SELECT 3, 'signup', user_id FROM s3
  UNION ALL SELECT 4, 'purchase', user_id FROM s4),
stages(stage, event_type) AS (VALUES (1, 'view'), (2, 'click'), (3, 'signup'), (4, 'purchase'))
"""

_STEPS = """
  subjects,
  lag(subjects) OVER steps AS prev_subjects,
  subjects / nullif(lag(subjects) OVER steps, 0) AS step_rate,
  subjects / nullif(first_value(subjects) OVER steps, 0) AS overall_rate,
  lag(subjects) OVER steps - subjects AS drop_off
"""

_TAGS = "list_distinct(list_append(string_split(p_name, ' '), lower(p_type)))"

_SLOTS = """
slots AS (
  SELECT c_custkey AS blogger_id, (c_custkey + i * 2) % 7 + 1 AS dow,
         (c_custkey * 3 + i * 5) % 24 AS start_h, ((c_custkey * 3 + i * 5) % 24 + 6) % 24 AS end_h
  FROM customer, generate_series(0, 3) AS g(i)
  WHERE c_acctbal >= 1000 * i)
"""

# Inside a slot, by day and hour; a slot that ends at or before its start reaches into the next
# day. The slots begin and end on whole hours.
_INSIDE = """
(end_h > start_h AND d = dow AND h >= start_h AND h < end_h)
OR (end_h <= start_h AND d = dow AND h >= start_h)
OR (end_h <= start_h AND d = dow % 7 + 1 AND h < end_h)
"""


def _excerpts(kind: str | None = None) -> str:
    where = f"WHERE event_type = '{kind}'" if kind else ""
    return f"""
SELECT user_id AS source_id, event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS start_s,
       CAST(floor(epoch(ts)) + greatest(floor(value), 30) * 60 AS BIGINT) AS end_s
FROM events {where}"""


def _overlaps(one: str, other: str) -> str:
    return f"""
WITH a AS ({_excerpts(one)}), b AS ({_excerpts(other)})
SELECT source_id, a.id AS id_a, b.id AS id_b, greatest(a.start_s, b.start_s) AS overlap_start,
       least(a.end_s, b.end_s) AS overlap_end,
       least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s) AS overlap
FROM a JOIN b USING (source_id) WHERE a.start_s < b.end_s AND b.start_s < a.end_s
"""


# A change of status of the content that was bought.
_STATE_OF = "s.user_id = p.user_id AND s.event_type <> 'purchase'"

_SESSIONS = """
begun AS (
  SELECT *, lag(ts) OVER history IS NULL OR ts > lag(ts) OVER history + INTERVAL 4 HOUR AS begins
  FROM events WINDOW history AS (PARTITION BY user_id ORDER BY ts)),
in_sessions AS (
  SELECT *, max(ts) FILTER (begins) OVER (PARTITION BY user_id ORDER BY ts) AS session_start FROM begun)
"""

_CONVERSIONS = f"""
SELECT v.user_id, v.event_id AS exposure_id, strftime(v.ts, {_TIME}) AS exposed_at, p.event_id AS conversion_id,
       strftime(p.ts, {_TIME}) AS converted_at, (epoch_us(p.ts) - epoch_us(v.ts)) / 1000000 AS lag_s
FROM events v JOIN events p ON v.user_id = p.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 DAY
WHERE v.event_type = 'view' AND p.event_type = 'purchase'
"""


def _state(year: int) -> str:
    return f"""
SELECT o_custkey AS blogger_id, o_orderstatus AS status, o_orderpriority AS queue
FROM orders WHERE year(o_orderdate) = {year}"""


def _topics(k: int) -> str:
    return f"""
WITH best AS (
  SELECT o_custkey AS blogger_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
         p_name AS title, max(l_extendedprice) AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY blogger_id, day ORDER BY score DESC, title) AS rank
FROM best QUALIFY rank <= {k}
"""


def _readiness(word: str) -> str:
    return f"""
SELECT c_custkey AS blogger_id, c_name AS name, c_mktsegment AS type,
       CAST(c_nationkey AS BIGINT) AS pool
FROM customer
WHERE {word} EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
"""


ORACLES: dict[str, str] = {
    "load_tables": " UNION ALL ".join(map(_table_check, _COLUMNS)),
    "search_filter": """
SELECT p_partkey AS program_id, p_name AS title, p_brand AS channel, p_type AS category
FROM part
WHERE p_type = 'PROMO' AND (p_name ILIKE '%ring%' OR p_brand ILIKE '%ring%')
""",
    "catalog_page": f"""
SELECT p_partkey AS program_id, p_name AS title, {_cents("p_retailprice")} AS price_cents,
       count(*) OVER () AS total_matches
FROM part WHERE p_name ILIKE '%widget%'
ORDER BY price_cents DESC, program_id LIMIT 25
""",
    "facet_counts": """
SELECT 'category' AS facet, p_type AS value, count(*) AS n FROM part GROUP BY ALL
UNION ALL SELECT 'channel', p_brand, count(*) FROM part GROUP BY ALL
UNION ALL SELECT 'size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY ALL
""",
    "status_tab_counts": """
SELECT 'status' AS tab, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL
UNION ALL SELECT 'all', NULL, count(*) FROM orders
""",
    "kpi_summary": f"""
SELECT count(*) AS events, count(DISTINCT user_id) AS users,
       count(*) FILTER (event_type = 'purchase') AS purchases,
       count(DISTINCT user_id) FILTER (event_type = 'purchase') AS buyers,
       CAST(sum({_cents("value")}) FILTER (event_type = 'purchase') AS BIGINT) AS revenue_cents
FROM events
""",
    "kpi_summary_two_columns": """
SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds, count(*) AS events
FROM events
""",
    "conversion_trend": """
WITH base AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events
              WHERE event_type = 'view' GROUP BY ALL),
     conv AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events
              WHERE event_type = 'purchase' GROUP BY ALL)
SELECT CAST(day AS VARCHAR) AS day, coalesce(base.n, 0) AS base_events,
       coalesce(conv.n, 0) AS conv_events,
       coalesce(conv.n, 0) / nullif(coalesce(base.n, 0), 0) AS rate
FROM base FULL JOIN conv USING (day)
""",
    "calendar_fill": """
WITH daily AS (SELECT o_orderstatus AS status, o_orderpriority AS queue,
                      CAST(o_orderdate AS DATE) AS day, count(*) AS items
               FROM orders GROUP BY ALL),
     series AS (SELECT DISTINCT status, queue FROM daily),
     days AS (SELECT CAST(unnest(generate_series(
                (SELECT min(day) FROM daily), (SELECT max(day) FROM daily), INTERVAL 1 DAY)) AS DATE)
              AS day)
SELECT status, queue, CAST(day AS VARCHAR) AS day, coalesce(items, 0) AS items
FROM series CROSS JOIN days LEFT JOIN daily USING (status, queue, day)
""",
    "calendar_fill_by_user": """
WITH daily AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL),
     days AS (SELECT CAST(unnest(generate_series(
                (SELECT min(day) FROM daily), (SELECT max(day) FROM daily), INTERVAL 1 DAY)) AS DATE)
              AS day),
     users AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, CAST(day AS VARCHAR) AS day, coalesce(n, 0) AS n
FROM users CROSS JOIN days LEFT JOIN daily USING (user_id, day)
""",
    "trend_by_kind": f"""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
       CAST(sum({_cents("value")}) FILTER (event_type = 'view') AS BIGINT) AS view,
       CAST(sum({_cents("value")}) FILTER (event_type = 'click') AS BIGINT) AS click,
       CAST(sum({_cents("value")}) FILTER (event_type = 'signup') AS BIGINT) AS signup,
       CAST(sum({_cents("value")}) FILTER (event_type = 'purchase') AS BIGINT) AS purchase
FROM events WHERE event_type <> 'error' GROUP BY 1
""",
    "ordered_funnel": f"""
WITH {_FUNNEL}
SELECT CAST(stage AS BIGINT) AS stage, event_type, count(user_id) AS subjects
FROM stages LEFT JOIN reached USING (stage, event_type) GROUP BY ALL
""",
    "funnel_transitions": f"""
WITH {_FUNNEL},
counts AS (SELECT stage, event_type, count(user_id) AS subjects
           FROM stages LEFT JOIN reached USING (stage, event_type) GROUP BY ALL)
SELECT CAST(stage AS BIGINT) AS stage, event_type, {_STEPS}
FROM counts WINDOW steps AS (ORDER BY stage)
""",
    "funnel_split": f"""
WITH {_FUNNEL},
typed AS (SELECT c_mktsegment AS type, stage, user_id
          FROM reached LEFT JOIN customer ON user_id = c_custkey),
types AS (SELECT DISTINCT c_mktsegment AS type FROM e LEFT JOIN customer ON user_id = c_custkey),
counts AS (SELECT types.type, stages.stage, event_type, count(user_id) AS subjects
           FROM types CROSS JOIN stages LEFT JOIN typed
             ON typed.type IS NOT DISTINCT FROM types.type AND typed.stage = stages.stage
           GROUP BY ALL)
SELECT type, CAST(stage AS BIGINT) AS stage, event_type, {_STEPS}
FROM counts WINDOW steps AS (PARTITION BY type ORDER BY stage)
""",
    "effect_ranking": f"""
SELECT row_number() OVER (ORDER BY metric DESC, blogger_id) AS rank, blogger_id, metric
FROM (SELECT o_custkey AS blogger_id, CAST(sum({_cents("o_totalprice")}) AS BIGINT) AS metric
      FROM orders GROUP BY ALL)
QUALIFY rank <= 20
""",
    "ranking_by_group": f"""
WITH effects AS (
  SELECT o_custkey AS blogger_id, CAST(sum({_cents("o_totalprice")}) AS BIGINT) AS effect_cents
  FROM orders GROUP BY ALL)
SELECT blogger_id, effect_cents, c_mktsegment AS type,
       row_number() OVER (PARTITION BY c_mktsegment ORDER BY effect_cents DESC, blogger_id) AS rank
FROM effects JOIN customer ON blogger_id = c_custkey
QUALIFY rank <= 10
""",
    "drilldown": f"""
SELECT CASE WHEN grouping(o_orderkey) = 1 THEN 'blogger_id' ELSE 'content_id' END AS level,
       o_custkey AS blogger_id, o_orderkey AS content_id, count(*) AS items,
       CAST(sum({_cents("o_totalprice")}) AS BIGINT) AS effect_cents,
       max({_cents("o_totalprice")}) AS best_cents,
       CAST(sum({_cents("o_totalprice")}) AS DOUBLE) / count(o_totalprice) AS mean_cents
FROM orders GROUP BY GROUPING SETS ((o_custkey, o_orderkey), (o_custkey))
""",
    "entity_stats": f"""
SELECT c_custkey AS blogger_id, c_name AS name, count(o_orderkey) AS items,
       CAST(coalesce(sum({_cents("o_totalprice")}), 0) AS BIGINT) AS effect_cents,
       coalesce(max({_cents("o_totalprice")}), 0) AS best_cents,
       count(DISTINCT o_orderpriority) AS queues
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'
GROUP BY ALL
""",
    "topic_suggestions_1": _topics(1),
    "topic_suggestions_2": _topics(2),
    "topic_suggestions_3": _topics(3),
    "tag_pool": f"""
WITH items AS (SELECT p_partkey AS item_id, {_TAGS} AS tags FROM part),
     profiles AS (SELECT c_custkey AS blogger_id, tags FROM customer
                  JOIN items ON item_id = c_custkey),
     pairs AS (SELECT p.blogger_id, i.item_id, count(*) AS shared
               FROM (SELECT blogger_id, unnest(tags) AS tag FROM profiles) p
               JOIN (SELECT item_id, unnest(tags) AS tag FROM items) i USING (tag)
               GROUP BY ALL)
SELECT blogger_id, count(*) OVER (PARTITION BY blogger_id) AS pool_size,
       row_number() OVER (PARTITION BY blogger_id ORDER BY shared DESC, item_id) AS rank,
       item_id, shared
FROM pairs QUALIFY rank <= 5
""",
    "related_items": f"""
WITH items AS (SELECT p_partkey AS item_id, {_TAGS} AS tags FROM part),
     tagged AS (SELECT item_id, len(tags) AS n, unnest(tags) AS tag FROM items),
     pairs AS (SELECT a.item_id, b.item_id AS related_item_id,
                      count(*) / (a.n + b.n - count(*)) AS similarity
               FROM tagged a JOIN tagged b USING (tag)
               WHERE a.item_id <> b.item_id
               GROUP BY a.item_id, b.item_id, a.n, b.n)
SELECT item_id, row_number() OVER (
         PARTITION BY item_id ORDER BY similarity DESC, related_item_id) AS rank,
       related_item_id, similarity
FROM pairs WHERE similarity >= 0.4 QUALIFY rank <= 5
""",
    "similar_items": f"""
WITH items AS (SELECT p_partkey AS item_id, {_TAGS} AS tags FROM part),
     tagged AS (SELECT item_id, len(tags) AS n, unnest(tags) AS tag FROM items),
     pairs AS (SELECT a.item_id, count(*) / (a.n + b.n - count(*)) AS similarity
               FROM tagged a JOIN tagged b USING (tag)
               WHERE a.item_id <> b.item_id
               GROUP BY a.item_id, b.item_id, a.n, b.n),
     alike AS (SELECT least(count(*), 5) AS n FROM pairs WHERE similarity >= 0.4 GROUP BY item_id)
SELECT rank, count(*) AS links, TRUE AS reached
FROM (SELECT unnest(generate_series(1, n)) AS rank FROM alike) GROUP BY 1
""",
    "linked_programs": """
WITH links AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, p_name
               FROM lineitem JOIN part ON l_partkey = p_partkey),
     linked AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey
                                              ORDER BY l_linenumber, l_partkey) - 1) // 4 AS page
                FROM links),
     pages AS (SELECT o_orderkey, 0 AS page FROM orders
               UNION SELECT l_orderkey, page FROM linked JOIN orders ON l_orderkey = o_orderkey)
SELECT o_orderkey AS content_id, CAST(pages.page AS BIGINT) AS page,
       coalesce(string_agg(l_linenumber || ':' || l_partkey || ':' || p_name, ', '
                           ORDER BY l_linenumber, l_partkey), '') AS programs
FROM pages LEFT JOIN linked ON l_orderkey = o_orderkey AND linked.page = pages.page
GROUP BY 1, 2
""",
    "expand_batch": """
SELECT c_custkey AS blogger_id, slot FROM customer, generate_series(1, 3) AS g(slot)
""",
    "capacity_check": """
WITH needed AS (SELECT o_custkey AS blogger_id, CAST(5 * count(*) AS BIGINT) AS needed
                FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL),
     usable AS (SELECT o_custkey AS blogger_id, count(DISTINCT l_partkey) AS usable
                FROM orders JOIN lineitem ON l_orderkey = o_orderkey
                WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT blogger_id, needed, coalesce(usable, 0) AS usable, coalesce(usable, 0) >= needed AS ok,
       greatest(needed - coalesce(usable, 0), 0) AS short_by
FROM needed LEFT JOIN usable USING (blogger_id)
""",
    "shared_capacity_check": f"""
WITH usable AS (SELECT c_nationkey, count(DISTINCT l_partkey) AS usable
                FROM orders JOIN customer ON o_custkey = c_custkey
                JOIN lineitem ON l_orderkey = o_orderkey
                WHERE o_orderstatus = 'F' GROUP BY ALL),
     demand AS (SELECT c_nationkey, CAST(left(o_orderpriority, 1) AS BIGINT) AS priority,
                       o_orderkey AS content_id, {_cents("o_totalprice")} // 5000000 + 1 AS n
                FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'),
     running AS (SELECT *, CAST(sum(n) OVER (
                   PARTITION BY c_nationkey ORDER BY priority, content_id
                   ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_need
                 FROM demand),
     checked AS (SELECT *, running_need <= coalesce(usable, 0) AS fits
                 FROM running LEFT JOIN usable USING (c_nationkey))
SELECT CAST(c_nationkey AS BIGINT) AS pool, priority, content_id, n, running_need,
       coalesce(usable, 0) AS usable, fits,
       NOT fits AND row_number() OVER (
         PARTITION BY c_nationkey, fits ORDER BY priority, content_id) = 1 AS overflows
FROM checked
""",
    "source_readiness": _readiness(""),
    "source_readiness_missing": _readiness("NOT"),
    "batch_progress": """
WITH items AS (SELECT l_orderkey, l_linestatus = 'F' AS done, l_linenumber, l_returnflag,
                      row_number() OVER (PARTITION BY l_orderkey, l_linestatus
                                         ORDER BY l_linenumber, l_returnflag) AS place
               FROM lineitem)
SELECT l_orderkey AS content_id, count(*) FILTER (done) AS done_items, count(*) AS total_items,
       count(*) FILTER (done) / count(*) AS ratio,
       CAST(any_value(l_linenumber) FILTER (NOT done AND place = 1) AS BIGINT) AS current_item,
       any_value(l_returnflag) FILTER (NOT done AND place = 1) AS current_phase
FROM items GROUP BY ALL
""",
    "queue_position": f"""
SELECT o_orderkey AS content_id, o_orderpriority AS queue,
       strftime(o_orderdate, {_TIME}) AS created_at,
       row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS position
FROM orders WHERE o_orderstatus = 'O'
""",
    "current_status": f"""
WITH {_SLOTS},
latest AS (SELECT user_id AS blogger_id, arg_max(event_type, ts) AS status, max(ts) AS since
           FROM events WHERE ts <= TIMESTAMP '2024-01-20 10:30:00' GROUP BY ALL),
-- 2024-01-20 is a Saturday; slots start on whole hours, so the next one is at 11.
live AS (SELECT blogger_id, bool_or({_INSIDE}) AS inside,
                bool_or(dow = 6 AND start_h = 11) AS starting
         FROM (SELECT *, 6 AS d, 10 AS h FROM slots) GROUP BY ALL)
SELECT blogger_id, status, strftime(since, {_TIME}) AS since,
       CASE WHEN inside THEN 'running' WHEN starting THEN 'soon'
            WHEN status = 'error' THEN 'review' ELSE 'ready' END AS state
FROM latest FULL JOIN live USING (blogger_id)
""",
    "status_history": f"""
SELECT user_id AS content_id, strftime(ts, {_TIME}) AS ts, event_id, event_type AS status,
       lag(event_type) OVER history AS prev_status,
       strftime(lead(ts) OVER history, {_TIME}) AS next_ts,
       (epoch_us(lead(ts) OVER history) - epoch_us(ts)) / 1000000 AS dwell_s
FROM events WINDOW history AS (PARTITION BY user_id ORDER BY ts, event_id)
""",
    "checklist_complete": """
WITH required AS (SELECT DISTINCT p_type FROM part WHERE p_type LIKE 'S%'),
     n AS (SELECT count(*) AS required FROM required),
     items AS (SELECT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey AS content_id,
       count(DISTINCT p_type) FILTER (p_type LIKE 'S%') AS checked,
       any_value(n.required) AS required,
       NOT bool_or(missing) AS complete
FROM (SELECT i.l_orderkey, i.p_type, EXISTS (
        SELECT 1 FROM required r WHERE NOT EXISTS (
          SELECT 1 FROM items j WHERE j.l_orderkey = i.l_orderkey AND j.p_type = r.p_type))
        AS missing
      FROM items i) CROSS JOIN n
GROUP BY l_orderkey
""",
    "checklist_complete_only": """
WITH required AS (SELECT DISTINCT p_type FROM part WHERE p_type LIKE 'S%'),
     checked AS (SELECT l_orderkey, count(DISTINCT p_type) AS checked
                 FROM lineitem JOIN part ON l_partkey = p_partkey
                 WHERE p_type LIKE 'S%' GROUP BY ALL)
SELECT l_orderkey AS content_id, checked, checked AS required, true AS complete
FROM checked WHERE checked = (SELECT count(*) FROM required)
""",
    "return_reasons": f"""
WITH returned AS (SELECT l_orderkey, {_TAGS} AS tags
                  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'),
     named AS (SELECT DISTINCT l_orderkey, unnest(tags) AS reason FROM returned)
SELECT reason, count(*) AS items,
       count(*) / (SELECT count(DISTINCT l_orderkey) FROM returned) AS share
FROM named GROUP BY ALL
""",
    "content_profile": """
SELECT CASE WHEN n_chars >= 8000 THEN 3 WHEN n_chars >= 2000 THEN 2 WHEN n_chars >= 500 THEN 1
            ELSE 0 END::BIGINT AS bucket,
       count(*) AS items, count(quality) AS scored, avg(quality) AS mean_score,
       count(quality) / count(*) AS coverage
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL
""",
    "new_entities": f"""
SELECT o_custkey AS blogger_id, strftime(min(o_orderdate), {_TIME}) AS first_seen,
       min(o_orderdate) > TIMESTAMP '1995-05-31 00:00:00' AS is_new
FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-30 00:00:00' GROUP BY ALL
""",
    "events_in_schedule": f"""
WITH {_SLOTS},
e AS (SELECT event_id, user_id AS blogger_id, ts, isodow(ts) AS d, hour(ts) AS h FROM events)
SELECT event_id, blogger_id, strftime(ts, {_TIME}) AS ts,
       EXISTS (SELECT 1 FROM slots WHERE slots.blogger_id = e.blogger_id AND ({_INSIDE}))
         AS in_schedule
FROM e
""",
    "schedule_summary": f"""
WITH {_SLOTS},
cells AS (SELECT blogger_id, dow, ((dow - 1) * 24 + start_h + j) % 168 AS cell
          FROM slots, generate_series(0, 5) AS g(j))
SELECT c_custkey AS blogger_id, c_name AS name, count(DISTINCT dow) AS days,
       CAST(count(DISTINCT cell) AS DOUBLE) AS weekly_hours, count(cell) > 0 AS configured
FROM customer LEFT JOIN cells ON blogger_id = c_custkey GROUP BY ALL
""",
    "merge_intervals": f"""
WITH x AS ({_excerpts()}),
     starts AS (SELECT DISTINCT source_id, start_s FROM x WHERE NOT EXISTS (
                  SELECT 1 FROM x y WHERE y.source_id = x.source_id
                  AND y.start_s < x.start_s AND y.end_s >= x.start_s)),
     ends AS (SELECT DISTINCT source_id, end_s FROM x WHERE NOT EXISTS (
                SELECT 1 FROM x y WHERE y.source_id = x.source_id
                AND y.start_s <= x.end_s AND y.end_s > x.end_s))
SELECT source_id, start_s, min(end_s) AS end_s
FROM starts JOIN ends USING (source_id) WHERE end_s > start_s GROUP BY ALL
""",
    "timeline_overlap": _overlaps("view", "click"),
    "timeline_overlap_buckets": _overlaps("view", "signup"),
    "live_counts": f"""
SELECT strftime(date_trunc('day', ts), {_TIME}) AS window_start,
       strftime(date_trunc('day', ts) + INTERVAL 1 DAY, {_TIME}) AS window_end,
       event_type, count(*) AS n
FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
GROUP BY ALL
""",
    "live_dedup": f"""
SELECT DISTINCT event_id, user_id, event_type, strftime(ts, {_TIME}) AS ts FROM events
""",
    "live_status": f"""
SELECT user_id AS content_id, strftime(max(ts), {_TIME}) AS ts, arg_max(event_id, ts) AS event_id,
       arg_max(event_type, ts) AS status
FROM events GROUP BY ALL
""",
    "status_as_of": f"""
SELECT user_id AS content_id, strftime(ts, {_TIME}) AS ts, event_id,
       (SELECT s.event_type FROM events s WHERE {_STATE_OF} AND s.ts <= p.ts
        ORDER BY s.ts DESC, s.event_id DESC LIMIT 1) AS status,
       strftime((SELECT max(s.ts) FROM events s WHERE {_STATE_OF} AND s.ts <= p.ts), {_TIME}) AS since
FROM events p WHERE event_type = 'purchase'
""",
    "status_after": f"""
SELECT user_id AS content_id, strftime(ts, {_TIME}) AS ts, event_id,
       (SELECT s.event_type FROM events s WHERE {_STATE_OF} AND s.ts >= p.ts AND s.ts <= p.ts + INTERVAL 6 HOUR
        ORDER BY s.ts, s.event_id LIMIT 1) AS status,
       strftime((SELECT min(s.ts) FROM events s WHERE {_STATE_OF} AND s.ts >= p.ts
                 AND s.ts <= p.ts + INTERVAL 6 HOUR), {_TIME}) AS at
FROM events p WHERE event_type = 'purchase'
""",
    "nearest_status": f"""
SELECT user_id AS content_id, strftime(ts, {_TIME}) AS ts, event_id, strftime(best.ts, {_TIME}) AS at,
       best.status AS status
FROM (SELECT user_id, ts, event_id, (
        SELECT struct_pack(ts := s.ts, status := s.event_type) FROM events s WHERE {_STATE_OF}
        ORDER BY abs(epoch_us(s.ts) - epoch_us(p.ts)), s.ts, CASE WHEN s.ts <= p.ts THEN -s.event_id ELSE s.event_id END
        LIMIT 1) AS best
      FROM events p WHERE event_type = 'purchase')
""",
    "sessions": f"""
WITH {_SESSIONS}
SELECT user_id, strftime(session_start, {_TIME}) AS session_start, strftime(max(ts), {_TIME}) AS session_end,
       count(*) AS events, (epoch_us(max(ts)) - epoch_us(session_start)) / 1000000 AS length_s,
       count(DISTINCT event_type) AS kinds,
       CAST(coalesce(sum({_cents("value")}) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS revenue_cents
FROM in_sessions GROUP BY user_id, session_start
""",
    "conversions_within": _CONVERSIONS,
    "live_sessions": f"""
WITH {_SESSIONS}
SELECT user_id, strftime(session_start, {_TIME}) AS session_start, strftime(max(ts), {_TIME}) AS session_end,
       count(*) AS events
FROM in_sessions GROUP BY user_id, session_start
HAVING max(ts) + INTERVAL 4 HOUR + INTERVAL 1 MICROSECOND
       <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)
""",
    "live_conversions": _CONVERSIONS,
    "live_states": f"""
WITH {_SLOTS},
-- The hours of the week inside a slot, and those at which one of the merged slots starts.
hours AS (SELECT DISTINCT blogger_id, (d - 1) * 24 + h AS cell
          FROM slots, generate_series(1, 7) AS a(d), generate_series(0, 23) AS b(h) WHERE {_INSIDE}),
begins AS (SELECT * FROM hours x WHERE NOT EXISTS (
             SELECT 1 FROM hours y WHERE y.blogger_id = x.blogger_id AND y.cell = (x.cell + 167) % 168)),
closed AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS until, min(ts) AS start FROM events),
-- Whatever can change a state: events, whole hours, and three days without an event.
e AS (SELECT user_id AS blogger_id, ts, arg_max(event_type, event_id) AS status,
             lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next_ts
      FROM events GROUP BY user_id, ts),
moments AS (
  SELECT blogger_id, ts AS t, struct_pack(s := status, at := ts) AS event FROM e
  UNION ALL
  SELECT blogger_id, hour, NULL FROM (SELECT DISTINCT blogger_id FROM e), (
    SELECT unnest(generate_series(date_trunc('hour', start), until, INTERVAL 1 HOUR)) AS hour FROM closed)
  UNION ALL
  SELECT blogger_id, ts + INTERVAL 3 DAY, NULL FROM e WHERE next_ts IS NULL OR next_ts > ts + INTERVAL 3 DAY),
known AS (
  SELECT blogger_id, t, last_value(max(event) IGNORE NULLS) OVER (PARTITION BY blogger_id ORDER BY t) AS latest
  FROM moments, closed WHERE t <= until GROUP BY blogger_id, t),
states AS (
  SELECT blogger_id, t, latest.at AS since, (isodow(t) - 1) * 24 + hour(t) AS cell,
         (epoch_us(t) + 3 * 86400000000) % (168 * 3600000000) AS now, latest.s AS latest_status,
         t >= latest.at + INTERVAL 3 DAY AS gone
  FROM known WHERE latest IS NOT NULL AND t <= latest.at + INTERVAL 3 DAY),
judged AS (
  SELECT blogger_id, t, since, CASE WHEN NOT gone THEN latest_status END AS status,
         CASE WHEN gone THEN NULL
              WHEN EXISTS (SELECT 1 FROM hours h WHERE h.blogger_id = s.blogger_id AND h.cell = s.cell) THEN 'running'
              WHEN EXISTS (SELECT 1 FROM begins b WHERE b.blogger_id = s.blogger_id
                AND (b.cell * 3600000000 - s.now + 168 * 3600000000) % (168 * 3600000000) BETWEEN 1 AND 3600000000) THEN 'soon'
              WHEN latest_status = 'error' THEN 'review' ELSE 'ready' END AS state
  FROM states s)
SELECT blogger_id, strftime(t, {_TIME}) AS at, state, status, strftime(since, {_TIME}) AS since
FROM judged WINDOW steps AS (PARTITION BY blogger_id ORDER BY t)
QUALIFY row_number() OVER steps = 1 OR state IS DISTINCT FROM lag(state) OVER steps
     OR status IS DISTINCT FROM lag(status) OVER steps
""",
    "distinct_counts": """
SELECT o_orderpriority AS queue, count(DISTINCT o_custkey) AS bloggers, TRUE AS within
FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1994-03-01' AND DATE '1995-10-31' GROUP BY ALL
""",
    "distinct_shared": """
SELECT queue, count(*) FILTER (years = 3) AS bloggers, TRUE AS within
FROM (SELECT o_orderpriority AS queue, o_custkey, count(DISTINCT year(o_orderdate)) AS years
      FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1996 GROUP BY ALL)
GROUP BY queue
""",
    "sliding_windows": f"""
WITH starts AS (
  SELECT unnest(generate_series(date_trunc('day', min(ts)) - INTERVAL 6 DAY, date_trunc('day', max(ts)),
                                INTERVAL 1 DAY)) AS w FROM events)
SELECT event_type, strftime(w, {_TIME}) AS window_start, strftime(w + INTERVAL 7 DAY, {_TIME}) AS window_end,
       count(*) AS events, CAST(sum(c) AS BIGINT) AS total_cents, min(c) AS least_cents, max(c) AS most_cents,
       sum(c) / count(*) AS mean_cents
FROM starts JOIN (SELECT *, {_cents("value")} AS c FROM events) ON ts >= w AND ts < w + INTERVAL 7 DAY
GROUP BY event_type, w
""",
    "merged_props": """
WITH whole AS (SELECT *, event_id % 11 = 0 AS cut FROM events),
names AS (
  SELECT user_id, k AS name, arg_max(v, (ts, event_id)) AS latest, count(*) AS times,
         sum(TRY_CAST(v AS DECIMAL(28,6))) AS total
  FROM (SELECT user_id, ts, event_id, unnest(json_keys(props)) AS k,
               unnest(list_transform(json_keys(props), lambda x: json_extract_string(props, '$."' || x || '"'))) AS v
        FROM whole WHERE NOT cut)
  GROUP BY user_id, k)
SELECT e.user_id, coalesce(string_agg(name || '=' || latest, ',' ORDER BY name), '') AS latest,
       coalesce(string_agg(name || '=' || CAST(total AS VARCHAR), ',' ORDER BY name), '') AS totals,
       coalesce(string_agg(name || '=' || times, ',' ORDER BY name), '') AS times, any_value(e.n) AS events,
       any_value(e.b) AS broken
FROM (SELECT user_id, count(*) AS n, count(*) FILTER (cut) AS b FROM whole GROUP BY user_id) e
LEFT JOIN names n ON n.user_id = e.user_id GROUP BY e.user_id
""",
    "state_changes": f"""
WITH a AS ({_state(1995)}), b AS ({_state(1996)})
SELECT *, 'added' AS change, count(*) AS n FROM (FROM b EXCEPT ALL FROM a) GROUP BY ALL
UNION ALL SELECT *, 'removed', count(*) FROM (FROM a EXCEPT ALL FROM b) GROUP BY ALL
UNION ALL SELECT *, 'kept', count(*) FROM (FROM a INTERSECT ALL FROM b) GROUP BY ALL
""",
    "dominance_counts": f"""
WITH p AS (SELECT p_partkey AS program_id, {_cents("p_retailprice")} AS price_cents, p_size AS size FROM part)
SELECT i.program_id, i.price_cents, CAST(i.size AS BIGINT) AS size, count(o.program_id) AS beaten_by
FROM p i LEFT JOIN p o ON o.price_cents < i.price_cents AND o.size > i.size GROUP BY ALL
""",
    "calendar_fill_range": """
WITH daily AS (SELECT o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day, count(*) AS items
               FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1992-12-20' AND DATE '1996-02-10' GROUP BY ALL),
     days AS (SELECT CAST(unnest(generate_series(DATE '1992-12-20', DATE '1996-02-10', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT status, CAST(day AS VARCHAR) AS day, coalesce(items, 0) AS items
FROM (SELECT DISTINCT status FROM daily) CROSS JOIN days LEFT JOIN daily USING (status, day)
""",
    "content_profile_median": """
SELECT CASE WHEN n_chars >= 8000 THEN 3 WHEN n_chars >= 2000 THEN 2 WHEN n_chars >= 500 THEN 1
            ELSE 0 END::BIGINT AS bucket,
       count(*) AS items, count(*) AS scored, avg(n_chars % 50) AS mean_score,
       quantile_disc(n_chars % 50, 0.5) AS median_score, CAST(1 AS DOUBLE) AS coverage
FROM documents GROUP BY ALL
""",
    "timeline_overlap_keyless": f"""
WITH a AS ({_excerpts("purchase")}), b AS ({_excerpts("error")})
SELECT CAST(floor(greatest(a.start_s, b.start_s) / 3600) AS BIGINT) AS hour, count(*) AS pairs,
       CAST(sum(least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s)) AS BIGINT) AS seconds
FROM a JOIN b ON a.start_s < b.end_s AND b.start_s < a.end_s GROUP BY ALL
""",
}
