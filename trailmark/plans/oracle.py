"""What each query must return, as plain SQL for another engine (DuckDB)."""

from __future__ import annotations

CLICKS = """
clicks AS (
  SELECT e.event_id, e.ts AS event_time,
         CASE e.event_type WHEN 'click' THEN 'cart' WHEN 'signup' THEN 'remove_from_cart'
              ELSE e.event_type END AS event_type,
         e.product_id, e.user_id, e.value AS price, p.p_brand AS brand, p.p_type AS category_code,
         concat(CAST(e.user_id AS VARCHAR), '_', CAST(CAST(e.ts AS DATE) AS VARCHAR)) AS user_session
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id FROM events) e
  LEFT JOIN part p ON p.p_partkey = e.product_id
)"""

ORDERS = """
orders_log AS (
  SELECT o.o_orderdate AS event_time,
         CASE o.o_orderstatus WHEN 'F' THEN 'purchase' WHEN 'P' THEN 'cart' ELSE 'view' END AS event_type,
         l.l_partkey AS product_id, o.o_custkey AS user_id, l.l_extendedprice AS price,
         p.p_brand AS brand, p.p_type AS category_code, c.c_mktsegment AS market,
         CASE WHEN c.c_acctbal >= 0 THEN 'credit' ELSE 'debit' END AS account_state
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN part p ON p.p_partkey = l.l_partkey
)"""

TIME = "'%Y-%m-%d %H:%M:%S.%f'"
CLICK_ROW = f"event_id, strftime(event_time, {TIME}) AS event_time, event_type, product_id, user_id, price"


def _money(value: str) -> str:
    """An exact sum: the test prices have two decimals."""
    return f"CAST(sum(CAST({value} AS DECIMAL(18, 2))) AS DOUBLE)"


def _pct(part: str, whole: str, digits: int = 2) -> str:
    return (
        f"CASE WHEN {whole} > 0 THEN round_even({part} / {whole} * 100.0, {digits}) ELSE 0.0 END"
    )


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def _gap_sessions(table: str, minutes: int, carried: str) -> str:
    """Sessions by pauses, one row per event, straight from the definition."""
    return f"""
flagged AS (
  SELECT {carried}, user_id, event_time,
         CASE WHEN lag(event_time) OVER w IS NULL
                OR event_time - lag(event_time) OVER w > INTERVAL '{minutes} minutes'
              THEN 1 ELSE 0 END AS starts
  FROM {table} WINDOW w AS (PARTITION BY user_id ORDER BY event_time)
),
sessioned AS (
  SELECT * EXCLUDE (starts),
         concat(CAST(user_id AS VARCHAR), '_', CAST(sum(starts) OVER (
           PARTITION BY user_id ORDER BY event_time
           RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS VARCHAR)) AS session_id
  FROM flagged
),
spans AS (
  SELECT user_id, session_id, min(event_time) AS session_start, max(event_time) AS session_end,
         count(*) AS events, count(*) FILTER (event_type = 'view') AS views,
         date_diff('microsecond', min(event_time), max(event_time)) AS duration_us
  FROM sessioned GROUP BY user_id, session_id
)"""


CLICK_SESSIONS = _with(CLICKS, _gap_sessions("clicks", 360, "event_id, event_type"))

# Sessions in order of length, and the values next to the 99th percentile.
CLICK_LENGTHS = (
    CLICK_SESSIONS
    + """, ordered AS (
  SELECT duration_us, row_number() OVER (ORDER BY duration_us) - 1 AS pos,
         0.99::DOUBLE * (count(*) OVER () - 1) AS target, count(*) OVER () AS total
  FROM spans
),
around AS (
  SELECT max(duration_us) FILTER (pos = floor(target)) AS lower,
         max(duration_us) FILTER (pos = least(floor(target) + 1, total - 1)) AS upper,
         max(target - floor(target)) AS fraction, max(total) AS total, min(duration_us) AS shortest
  FROM ordered
),
bounds AS (
  SELECT lower, total, shortest / 60e6 AS min_min,
         lower / 60e6 + (upper / 60e6 - lower / 60e6) * fraction AS cap_min
  FROM around
)"""
)

FUNNEL = (
    _with(ORDERS)
    + f""", stages AS (
  SELECT user_id, max(CASE event_type WHEN 'view' THEN 1 WHEN 'cart' THEN 2
                      WHEN 'remove_from_cart' THEN 2 WHEN 'purchase' THEN 3 END) AS reached
  FROM orders_log GROUP BY user_id
),
counts AS (
  SELECT s.position, s.stage, s.label, count(*) FILTER (reached >= s.position) AS users,
         count(reached) AS total
  FROM stages, (VALUES (1, 'view', 'Product View'), (2, 'cart', 'Add to Cart'),
                       (3, 'purchase', 'Purchase')) s(position, stage, label)
  GROUP BY s.position, s.stage, s.label
),
funnel AS (
  SELECT position, stage, label, users, {_pct("users", "total")} AS percentage,
         CASE WHEN lag(users) OVER (ORDER BY position) > 0
              THEN round_even((1 - users / lag(users) OVER (ORDER BY position)) * 100, 2)
              ELSE 0.0 END AS drop_off_pct
  FROM counts
)"""
)

KPIS = (
    _with(ORDERS)
    + f""", users AS (
  SELECT user_id, bool_or(event_type = 'view') AS viewed, bool_or(event_type = 'cart') AS carted,
         bool_or(event_type = 'purchase') AS bought
  FROM orders_log GROUP BY user_id
),
people AS (
  SELECT count(*) FILTER (viewed) AS viewers, count(*) FILTER (carted) AS carters,
         count(*) FILTER (bought) AS buyers, count(*) FILTER (carted AND NOT bought) AS leavers
  FROM users
),
totals AS (
  SELECT count(*) AS total_events, count(DISTINCT user_id) AS unique_users,
         count(DISTINCT product_id) AS unique_products,
         {_money("CASE WHEN event_type = 'purchase' THEN price END")} AS revenue,
         count(price) FILTER (event_type = 'purchase') AS paid
  FROM orders_log
),
kpis AS (
  SELECT total_events, unique_users, unique_products, round_even(revenue, 2) AS total_revenue,
         round_even(revenue / paid, 2) AS avg_order_value,
         {_pct("buyers", "viewers")} AS overall_conversion_rate,
         {_pct("leavers", "carters")} AS cart_abandonment_rate
  FROM totals, people
)"""
)

COHORT = (
    _with(ORDERS)
    + """, months AS (
  SELECT DISTINCT user_id, date_trunc('month', event_time) AS month FROM orders_log
),
assigned AS (
  SELECT user_id, strftime(month, '%Y-%m') AS active_month,
         strftime(min(month) OVER (PARTITION BY user_id), '%Y-%m') AS cohort,
         date_diff('month', min(month) OVER (PARTITION BY user_id), month) AS period
  FROM months
),
active AS (
  SELECT cohort, period, count(DISTINCT user_id) AS active_users
  FROM assigned WHERE period <= 12 GROUP BY cohort, period
),
sizes AS (SELECT cohort, active_users AS cohort_size FROM active WHERE period = 0),
retention AS (
  SELECT cohort, """
    + ", ".join(
        "coalesce(round_even(max(active_users) FILTER (period = {0})"
        " / max(cohort_size) * 100.0, 1), 0.0) AS M{0}".format(p)
        for p in range(13)
    )
    + """
  FROM active JOIN sizes USING (cohort) GROUP BY cohort
)"""
)

SEGMENTS = (
    _with(ORDERS, _gap_sessions("orders_log", 30 * 24 * 60, "event_type, price"))
    + f""", per_user AS (
  SELECT user_id, count(event_type) AS total_events,
         count(*) FILTER (event_type = 'view') AS total_views,
         count(*) FILTER (event_type = 'cart') AS total_carts,
         count(*) FILTER (event_type = 'purchase') AS total_purchases,
         round_even({_money("price")} / count(price), 2) AS avg_price,
         count(DISTINCT session_id) AS session_count
  FROM sessioned GROUP BY user_id
),
lengths AS (
  SELECT user_id, round_even(CAST(sum(duration_us) AS BIGINT) / 1e6 / count(*), 1)
           AS avg_session_duration_sec
  FROM spans GROUP BY user_id
),
segments AS (
  SELECT *, CASE WHEN total_purchases > 0 THEN 'Purchaser'
                 WHEN total_carts > 0 THEN 'Cart Abandoner' ELSE 'Browser' END AS segment
  FROM per_user JOIN lengths USING (user_id)
)"""
)

FEATURES = [
    "total_events", "total_views", "total_carts",
    "total_purchases", "avg_price", "session_count",
]


def _scaled(name: str) -> str:
    spread = f"stddev_pop({name}) OVER ()"
    return (
        f"round_even(CASE WHEN {spread} > 0 THEN ({name} - avg({name}) OVER ()) / {spread}"
        " ELSE 0.0 END, 6)"
    )


SLOTS = (
    _with(CLICKS)
    + """, slots AS (
  SELECT isodow(event_time) - 1 AS weekday, hour(event_time) AS hour, event_type
  FROM clicks WHERE event_time IS NOT NULL AND event_type IS NOT NULL
)"""
)

BRANDS = (
    _with(CLICKS)
    + f""", counted AS (
  SELECT brand, count(event_type) AS total_events,
         count(*) FILTER (event_type = 'view') AS views,
         count(*) FILTER (event_type = 'cart') AS carts,
         count(*) FILTER (event_type = 'purchase') AS purchases,
         round_even({_money("price")} / count(price), 2) AS avg_price,
         count(DISTINCT product_id) AS unique_products
  FROM clicks WHERE brand IS NOT NULL GROUP BY brand HAVING count(event_type) >= 100
),
brands AS (
  SELECT *, {_pct("carts", "views")} AS view_to_cart_rate,
         {_pct("purchases", "carts")} AS cart_to_purchase_rate,
         {_pct("purchases", "views")} AS overall_conversion_rate
  FROM counted ORDER BY total_events DESC, brand LIMIT 15
)"""
)


def _contingency(factor: str) -> str:
    return f"""
  SELECT '{factor}' AS factor, {factor} AS "group",
         count(*) FILTER (NOT bought) AS not_purchased, count(*) FILTER (bought) AS purchased
  FROM buyers GROUP BY {factor}"""


CONTINGENCY = (
    _with(ORDERS)
    + """, buyers AS (
  SELECT user_id, arg_min(market, event_time) AS market,
         arg_min(account_state, event_time) AS account_state,
         min(struct_pack(t := event_time, b := brand)).b AS brand,
         bool_or(event_type = 'purchase') AS bought
  FROM orders_log GROUP BY user_id
),
contingency AS ("""
    + _contingency("market")
    + " UNION ALL "
    + _contingency("account_state")
    + " UNION ALL "
    + _contingency("brand")
    + ")"
)

# The error function for one degree of freedom is summed as a power series.
CHI_SQUARE = (
    CONTINGENCY
    + """, cells AS (
  SELECT factor, not_purchased + purchased AS size, not_purchased AS seen,
         sum(not_purchased) OVER f AS column_total, sum(not_purchased + purchased) OVER f AS users,
         count(*) OVER f AS groups
  FROM contingency WINDOW f AS (PARTITION BY factor)
  UNION ALL
  SELECT factor, not_purchased + purchased, purchased, sum(purchased) OVER f,
         sum(not_purchased + purchased) OVER f, count(*) OVER f
  FROM contingency WINDOW f AS (PARTITION BY factor)
),
expected AS (
  SELECT factor, groups - 1 AS dof, size * column_total / users AS e,
         abs(seen - size * column_total / users) AS apart
  FROM cells
),
statistic AS (
  SELECT factor, dof,
         sum(power(CASE WHEN dof = 1 THEN apart - least(0.5, apart) ELSE apart END, 2) / e) AS chi2
  FROM expected GROUP BY factor, dof
),
tails AS (
  SELECT factor, dof, chi2,
         CASE dof WHEN 4 THEN exp(-chi2 / 2) * (1 + chi2 / 2)
                  WHEN 24 THEN exp(-chi2 / 2) * (
                    SELECT sum(power(chi2 / 2, n) / gamma(n + 1)) FROM range(12) t(n))
                  WHEN 1 THEN 1 - 2 / sqrt(pi()) * (
                    SELECT sum(power(-1, n) * power(sqrt(chi2 / 2), 2 * n + 1)
                               / (gamma(n + 1) * (2 * n + 1)))
                    FROM range(60) t(n)) END AS p
  FROM statistic
)"""
)

LONE = (
    _with(CLICKS)
    + """, lone_log AS (
  SELECT * EXCLUDE (user_id, k), CASE WHEN event_id % 7 <> 0 THEN user_id END AS user_id
  FROM (SELECT *, unnest(CASE WHEN event_id % 21 = 0 THEN [1, 2] ELSE [1] END) AS k FROM clicks)
),
flagged AS (
  SELECT *, CASE WHEN lag(event_time) OVER w IS NULL
                   OR event_time - lag(event_time) OVER w > INTERVAL '360 minutes' THEN 1 ELSE 0 END AS starts
  FROM lone_log WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_time)
),
numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY event_time
                              RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seq FROM flagged
),
known AS (
  SELECT user_id, seq, count(*) AS events, epoch_us(max(event_time)) - epoch_us(min(event_time)) AS us
  FROM numbered GROUP BY ALL
)"""
)

SPOILED = (
    _with(CLICKS)
    + """, n AS (
  SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS unknown,
         count(*) FILTER (event_id % 10 = 3) AS bad_time, count(*) FILTER (event_id % 20 <> 0 OR product_id IS NULL) AS no_product,
         count(*) FILTER (event_id % 5 <= 1 OR user_id IS NULL) AS no_user,
         count(*) FILTER (event_id % 5 < 3) AS bad_price, count(*) FILTER (event_id % 5 = 3) AS negative
  FROM clicks
)"""
)

ORACLE: dict[str, str] = {
    "normalize_event_type": """
      SELECT CAST(event_id AS VARCHAR) AS event_id, event_type FROM events""",
    "coerce_price": """
      SELECT CAST(event_id AS VARCHAR) AS event_id,
             CASE WHEN event_type = 'error' THEN NULL ELSE value END AS price
      FROM events""",
    "parse_event_time": f"""
      SELECT CAST(event_id AS VARCHAR) AS event_id,
             strftime(CASE event_type
                      WHEN 'click' THEN date_trunc('minute', ts)
                      WHEN 'view' THEN ts
                      WHEN 'signup' THEN CAST(date_trunc('day', ts) AS TIMESTAMP)
                      ELSE date_trunc('second', ts) END, {TIME}) AS event_time
      FROM events""",
    "coerce_columns": _with(CLICKS)
    + """SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS user_id,
                CAST(product_id AS VARCHAR) AS product_id, price, brand
         FROM clicks""",
    "filter_date_range": _with(CLICKS)
    + f"""SELECT {CLICK_ROW} FROM clicks
          WHERE event_time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 23:59:59'""",
    "filter_brands": _with(CLICKS)
    + """SELECT event_id, brand, price FROM clicks
         WHERE brand IN ('Brand#1', 'Brand#2', 'Brand#13')""",
    "apply_filters": _with(CLICKS)
    + f"""SELECT {CLICK_ROW} FROM clicks
          WHERE event_time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 23:59:59'
            AND brand IN ('Brand#1', 'Brand#2', 'Brand#13')""",
    "date_bounds": _with(CLICKS)
    + """SELECT CAST(min(CAST(event_time AS DATE)) AS VARCHAR) AS min_date,
                CAST(max(CAST(event_time AS DATE)) AS VARCHAR) AS max_date
         FROM clicks""",
    "brand_options": _with(CLICKS)
    + "SELECT DISTINCT brand FROM clicks WHERE brand IS NOT NULL ORDER BY brand",
    "bot_users": _with(CLICKS)
    + """SELECT user_id, max(n) AS peak_day_events
         FROM (SELECT user_id, CAST(event_time AS DATE) AS day, count(*) AS n
               FROM clicks GROUP BY ALL) d
         WHERE n > 6 GROUP BY user_id""",
    "remove_bots": _with(CLICKS)
    + f"""SELECT {CLICK_ROW} FROM clicks
          WHERE user_id NOT IN (
            SELECT user_id FROM clicks GROUP BY user_id, CAST(event_time AS DATE) HAVING count(*) > 6)""",
    "deduplicate_events": _with(ORDERS)
    + f"""SELECT strftime(event_time, {TIME}) AS event_time, event_type, product_id, user_id,
                 min(price) AS price
          FROM orders_log o GROUP BY o.event_time, event_type, product_id, user_id""",
    "cleaning_report": _with(ORDERS)
    + """, bots AS (
      SELECT DISTINCT user_id FROM (
        SELECT user_id FROM orders_log GROUP BY user_id, CAST(event_time AS DATE)
        HAVING count(*) > 8) b
    ),
    kept AS (SELECT * FROM orders_log WHERE user_id NOT IN (SELECT user_id FROM bots)),
    counts AS (
      SELECT (SELECT count(*) FROM bots) AS bot_users,
             (SELECT count(*) FROM orders_log) AS rows_in,
             (SELECT count(*) FROM kept) AS rows_without_bots,
             (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type, product_id, event_time
                                    FROM kept) d) AS rows_out
    )
    SELECT *, rows_without_bots - rows_out AS duplicates_removed,
           round_even((rows_without_bots - rows_out) / rows_without_bots * 100.0, 1) AS duplicate_pct
    FROM counts""",
    "sessions_existing": _with(CLICKS)
    + """SELECT event_id, user_session AS session_id,
                date_diff('microsecond', min(event_time) OVER w, max(event_time) OVER w) / 1e6
                  AS session_duration_sec
         FROM clicks WINDOW w AS (PARTITION BY user_session)""",
    "sessions_gap": CLICK_SESSIONS
    + """SELECT event_id, session_id, duration_us / 1e6 AS session_duration_sec
         FROM sessioned JOIN spans USING (user_id, session_id)""",
    "sessions_gap_running_ids": CLICK_SESSIONS
    + """, numbered AS (
      SELECT user_id, session_id, duration_us,
             row_number() OVER (ORDER BY user_id, session_start) AS number
      FROM spans
    )
    SELECT event_id, CAST(number AS VARCHAR) AS session_id,
           duration_us / 1e6 AS session_duration_sec
    FROM sessioned JOIN numbered USING (user_id, session_id)""",
    "sessions_without_user": LONE
    + """SELECT event_id, user_id, count(*) AS events, count(DISTINCT seq) AS sessions,
             max(us / 1e6) AS session_duration_sec
      FROM numbered JOIN known USING (user_id, seq) GROUP BY event_id, user_id
      UNION ALL
      SELECT event_id, NULL, count(*), count(*), 0.0 FROM lone_log WHERE user_id IS NULL GROUP BY event_id""",
    "session_table_without_user": LONE
    + """SELECT user_id, count(*) AS sessions, count(*) AS matched, CAST(sum(events) AS BIGINT) AS events,
             CAST(sum(us) AS BIGINT) AS duration_us
      FROM known GROUP BY user_id
      UNION ALL
      SELECT NULL, count(*), count(*), count(*), 0 FROM lone_log WHERE user_id IS NULL""",
    "running_ids_without_user": LONE
    + """, per_user AS (
        SELECT user_id, count(*) AS sessions FROM known GROUP BY user_id
        UNION ALL
        SELECT NULL, count(*) FROM lone_log WHERE user_id IS NULL
      ),
      ends AS (
        SELECT *, CAST(sum(sessions) OVER (ORDER BY user_id NULLS LAST) AS BIGINT) AS last FROM per_user
      )
      SELECT user_id, last - sessions + 1 AS first, last, sessions FROM ends""",
    "session_durations": _with(CLICKS)
    + """SELECT user_session AS session_id, count(*) AS events,
                date_diff('microsecond', min(event_time), max(event_time)) / 1e6
                  AS session_duration_sec
         FROM clicks GROUP BY user_session""",
    "session_summary": CLICK_SESSIONS
    + f"""SELECT user_id, session_id, strftime(session_start, {TIME}) AS session_start,
                 strftime(session_end, {TIME}) AS session_end, events, views,
                 duration_us / 1e6 AS session_duration_sec
          FROM spans""",
    "session_metrics": CLICK_SESSIONS
    + """SELECT count(*) AS session_count,
                round_even(CAST(sum(duration_us) AS BIGINT) / 1e6 / count(*), 2)
                  AS avg_session_duration_sec,
                round_even(CAST(sum(views) AS BIGINT) / count(*), 2) AS avg_products_viewed
         FROM spans""",
    "session_length_p99": CLICK_LENGTHS
    + """SELECT total AS sessions, round_even(cap_min, 4) AS cap_min,
                (SELECT count(*) FROM spans WHERE duration_us / 60e6 <= cap_min) AS sessions_kept
         FROM bounds""",
    "session_length_histogram": CLICK_LENGTHS
    + """, binned AS (
      SELECT CAST(least(floor((duration_us / 60e6 - min_min) / ((cap_min - min_min) / 50)), 49)
                  AS BIGINT) + 1 AS bin, min_min, (cap_min - min_min) / 50 AS width
      FROM spans, bounds WHERE duration_us / 60e6 <= cap_min
    )
    , every AS (
      SELECT unnest(range(1, 51)) AS bin, min_min, (cap_min - min_min) / 50 AS width FROM bounds
    )
    SELECT e.bin, round_even(e.min_min + e.width * (e.bin - 1), 4) AS from_min,
           round_even(e.min_min + e.width * e.bin, 4) AS to_min, count(b.bin) AS sessions
    FROM every e LEFT JOIN binned b USING (bin) GROUP BY e.bin, e.min_min, e.width ORDER BY e.bin""",
    "funnel": FUNNEL
    + """SELECT stage, label, users, percentage, drop_off_pct FROM funnel ORDER BY position""",
    "funnel_table": FUNNEL
    + """SELECT label AS "Stage", users AS "Users", percentage AS "% of Total",
                drop_off_pct AS "Drop-off %"
         FROM funnel ORDER BY position""",
    "funnel_step_rates": FUNNEL
    + f""", u AS (
      SELECT max(users) FILTER (position = 1) AS v, max(users) FILTER (position = 2) AS c,
             max(users) FILTER (position = 3) AS p
      FROM funnel
    )
    SELECT {_pct("c", "v")} AS view_to_cart_pct, {_pct("p", "c")} AS cart_to_purchase_pct,
           {_pct("p", "v")} AS view_to_purchase_pct
    FROM u""",
    "funnel_biggest_drop": FUNNEL
    + """SELECT label, round_even(drop_off_pct, 1) AS drop_off_pct
         FROM funnel ORDER BY funnel.drop_off_pct DESC, position LIMIT 1""",
    "kpis": KPIS + "SELECT * FROM kpis",
    "quick_stats": KPIS
    + """SELECT 'Avg Order Value' AS "Metric", format('${:.2f}', avg_order_value) AS "Value" FROM kpis
         UNION ALL
         SELECT 'Overall Conversion Rate', concat(CAST(overall_conversion_rate AS VARCHAR), '%') FROM kpis
         UNION ALL
         SELECT 'Cart Abandonment Rate', concat(CAST(cart_abandonment_rate AS VARCHAR), '%') FROM kpis
         UNION ALL
         SELECT 'Total Revenue', format('${:,.2f}', total_revenue) FROM kpis""",
    "kpi_cards": KPIS
    + """SELECT 'Total Events' AS "Metric", format('{:,}', total_events) AS "Value" FROM kpis
         UNION ALL SELECT 'Unique Users', format('{:,}', unique_users) FROM kpis
         UNION ALL SELECT 'Unique Products', format('{:,}', unique_products) FROM kpis
         UNION ALL SELECT 'Total Revenue', format('${:,.2f}', total_revenue) FROM kpis
         UNION ALL
         SELECT 'Conversion Rate', concat(CAST(overall_conversion_rate AS VARCHAR), '%') FROM kpis
         UNION ALL
         SELECT 'Cart Abandon Rate', concat(CAST(cart_abandonment_rate AS VARCHAR), '%') FROM kpis""",
    "cohort_assign": COHORT + "SELECT * FROM assigned",
    "cohort_active_users": COHORT + "SELECT * FROM active",
    "cohort_sizes": COHORT + "SELECT * FROM sizes ORDER BY cohort",
    "cohort_retention": COHORT + "SELECT * FROM retention ORDER BY cohort",
    "cohort_heatmap_labels": COHORT
    + "SELECT cohort, "
    + ", ".join(
        f"CASE WHEN M{p} > 0 THEN format('{{:.1f}}%', M{p}) ELSE '' END AS M{p}" for p in range(13)
    )
    + " FROM retention ORDER BY cohort",
    "cohort_avg_m1": COHORT
    + """, mean AS (
      SELECT CAST(sum(CAST(M1 AS DECIMAL(18, 1))) AS DOUBLE) / count(*) AS m1 FROM retention
    )
    SELECT round_even(m1, 1) AS avg_m1_retention,
           CASE WHEN m1 > 20 THEN 'healthy' ELSE 'low' END AS engagement
    FROM mean""",
    "segment_users": SEGMENTS + "SELECT * FROM segments",
    "segment_distribution": SEGMENTS
    + """SELECT segment, count(*) AS users,
                round_even(count(*) / (SELECT count(*) FROM segments) * 100.0, 1) AS share_pct
         FROM segments GROUP BY segment ORDER BY users DESC, segment""",
    "segment_summary": SEGMENTS
    + f"""SELECT segment, count(*) AS users,
                 round_even(CAST(sum(total_events) AS BIGINT) / count(*), 1) AS avg_events,
                 round_even(CAST(sum(total_views) AS BIGINT) / count(*), 1) AS avg_views,
                 round_even(CAST(sum(total_carts) AS BIGINT) / count(*), 1) AS avg_carts,
                 round_even(CAST(sum(total_purchases) AS BIGINT) / count(*), 1) AS avg_purchases,
                 round_even({_money("s.avg_price")} / count(s.avg_price), 1) AS avg_price,
                 round_even({_money("avg_session_duration_sec")} / count(*), 1)
                   AS avg_session_duration
          FROM segments s GROUP BY segment ORDER BY segment""",
    "segment_metrics": SEGMENTS
    + f"""SELECT segment,
                 round_even(CAST(sum(total_events) AS BIGINT) / count(*), 1) AS avg_events,
                 round_even(CAST(sum(total_views) AS BIGINT) / count(*), 1) AS avg_views,
                 round_even({_money("s.avg_price")} / count(s.avg_price), 1) AS avg_price,
                 round_even(CAST(sum(session_count) AS BIGINT) / count(*), 1) AS avg_sessions
          FROM segments s GROUP BY segment ORDER BY segment""",
    "cluster_summary_of_labels": SEGMENTS
    + """, counted AS (
           SELECT CAST(user_id % 4 AS INTEGER) AS cluster, segment, count(*) AS n,
                  sum(total_events) AS events, sum(total_purchases) AS purchases
           FROM segments GROUP BY ALL
         )
         SELECT cluster, CAST(sum(n) AS BIGINT) AS users,
                round_even(CAST(sum(events) AS BIGINT) / CAST(sum(n) AS BIGINT), 1) AS avg_events,
                round_even(CAST(sum(purchases) AS BIGINT) / CAST(sum(n) AS BIGINT), 1) AS avg_purchases,
                first(segment ORDER BY n DESC, segment) AS dominant_segment
         FROM counted GROUP BY cluster ORDER BY cluster""",
    "cart_abandoners": _with(ORDERS)
    + """SELECT DISTINCT user_id FROM orders_log WHERE event_type = 'cart'
         EXCEPT SELECT user_id FROM orders_log WHERE event_type = 'purchase'""",
    "user_features_scaled": SEGMENTS
    + "SELECT user_id, "
    + ", ".join(f"{_scaled(name)} AS {name}_scaled" for name in FEATURES)
    + f", {_scaled('total_events')} AS pc1, {_scaled('total_views')} AS pc2 FROM segments",
    "hourly_events": SLOTS
    + 'SELECT hour, event_type, count(*) AS "count" FROM slots GROUP BY hour, event_type',
    "weekday_events": SLOTS
    + """SELECT weekday, ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday',
                          'Sunday'][weekday + 1] AS weekday_name, event_type, count(*) AS "count"
         FROM slots GROUP BY weekday, event_type""",
    "purchase_heatmap": SLOTS
    + "SELECT hour, "
    + ", ".join(
        f"count(*) FILTER (weekday = {i}) AS {day}"
        for i, day in enumerate(["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"])
    )
    + " FROM slots WHERE event_type = 'purchase' GROUP BY hour ORDER BY hour",
    "purchase_heatmap_labels": SLOTS
    + "SELECT concat(lpad(CAST(hour AS VARCHAR), 2, '0'), ':00') AS hour_label, "
    + ", ".join(
        f"count(*) FILTER (weekday = {i}) AS {day}"
        for i, day in enumerate(["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"])
    )
    + " FROM slots WHERE event_type = 'purchase' GROUP BY hour ORDER BY hour",
    "purchases_by_hour": SLOTS
    + """SELECT hour, count(*) AS "count" FROM slots WHERE event_type = 'purchase'
         GROUP BY hour ORDER BY hour""",
    "peak_purchase_time": SLOTS
    + """, h AS (
      SELECT hour FROM slots WHERE event_type = 'purchase'
      GROUP BY hour ORDER BY count(*) DESC, hour LIMIT 1
    ),
    d AS (
      SELECT weekday FROM slots WHERE event_type = 'purchase'
      GROUP BY weekday ORDER BY count(*) DESC, weekday LIMIT 1
    )
    SELECT hour AS peak_hour,
           ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][weekday + 1] AS peak_day,
           concat(CAST(hour AS VARCHAR), ':00') AS peak_label
    FROM h, d""",
    "event_distribution": _with(CLICKS)
    + """SELECT event_type, count(*) AS "count",
                round_even(count(*) / (SELECT count(event_type) FROM clicks) * 100.0, 1) AS share_pct
         FROM clicks WHERE event_type IS NOT NULL
         GROUP BY event_type ORDER BY count(*) DESC, event_type""",
    "daily_events": _with(CLICKS)
    + """SELECT CAST(CAST(event_time AS DATE) AS VARCHAR) AS "date", event_type, count(*) AS "count"
         FROM clicks GROUP BY CAST(event_time AS DATE), event_type""",
    "brand_analysis": BRANDS
    + """SELECT brand, total_events, views, carts, purchases, avg_price, unique_products,
                view_to_cart_rate, cart_to_purchase_rate, overall_conversion_rate
         FROM brands ORDER BY total_events DESC, brand""",
    "brand_conversion_table": BRANDS
    + """SELECT brand, views, carts, purchases, view_to_cart_rate, cart_to_purchase_rate,
                overall_conversion_rate, avg_price
         FROM brands ORDER BY overall_conversion_rate DESC, brand""",
    "top_converting_brand": BRANDS
    + """SELECT brand, overall_conversion_rate, purchases, views
         FROM brands ORDER BY overall_conversion_rate DESC, brand LIMIT 1""",
    "brand_comparison": BRANDS
    + "SELECT brand, views, carts, purchases FROM brands ORDER BY total_events, brand DESC",
    "validation_report": SPOILED
    + """SELECT 'clean' AS log, level, "check", CAST(count AS BIGINT) AS count FROM n, LATERAL (VALUES
        ('info', 'rows', n), ('info', 'columns', 7), ('warning', 'missing_category_id', 1),
        ('warning', 'missing_category_code', 1), ('warning', 'missing_brand', 1),
        ('warning', 'unknown_type_rows', unknown)) AS f(level, "check", count)
      UNION ALL
      SELECT 'spoiled', level, "check", CAST(count AS BIGINT) FROM n, LATERAL (VALUES
        ('info', 'rows', n), ('info', 'columns', 6), ('warning', 'missing_category_id', 1),
        ('warning', 'missing_category_code', 1), ('warning', 'missing_brand', 1),
        ('warning', 'missing_user_session', 1), ('warning', 'unknown_type_rows', unknown),
        ('warning', 'bad_price_rows', bad_price), ('warning', 'negative_price_rows', negative),
        ('warning', 'null_product_id', no_product), ('error', 'null_product_id', no_product),
        ('warning', 'null_user_id', no_user), ('error', 'bad_time_rows', bad_time)) AS f(level, "check", count)
      UNION ALL
      SELECT 'empty', level, "check", CAST(count AS BIGINT) FROM (VALUES
        ('info', 'rows', 0), ('info', 'columns', 7), ('error', 'no_rows', 0)) AS f(level, "check", count)
      UNION ALL
      SELECT 'narrow', level, "check", CAST(count AS BIGINT) FROM n, LATERAL (VALUES
        ('info', 'rows', n), ('info', 'columns', 5), ('error', 'missing_user_id', 1),
        ('error', 'missing_price', 1), ('warning', 'missing_category_id', 1),
        ('warning', 'missing_category_code', 1), ('warning', 'missing_brand', 1),
        ('warning', 'unknown_type_rows', unknown)) AS f(level, "check", count)""",
    "csv_round_trip": f"""
      SELECT CAST(event_id AS VARCHAR) AS event_id, event_type,
             strftime(CASE event_type
                      WHEN 'click' THEN date_trunc('minute', ts)
                      WHEN 'view' THEN ts
                      WHEN 'signup' THEN CAST(date_trunc('day', ts) AS TIMESTAMP)
                      ELSE date_trunc('second', ts) END, {TIME}) AS event_time,
             CASE WHEN event_type = 'error' THEN NULL ELSE value END AS price,
             concat('said "', event_type, '",', chr(10), 'then left') AS note
      FROM events""",
    "kmeans_properties": _with(ORDERS)
    + """SELECT count(DISTINCT user_id) AS users, 4 AS clusters, 0 AS misplaced, 0 AS unmatched
      FROM orders_log""",
    "data_quality_metrics": _with(CLICKS)
    + "SELECT count(*) AS row_count, CAST(7 AS BIGINT) AS column_count, "
    + """count(*) FILTER (event_type NOT IN ('view', 'cart', 'remove_from_cart', 'purchase'))
           AS unknown_type_rows,
         count(*) FILTER (event_type = 'view') AS view_rows,
         count(*) FILTER (price IS NULL) AS bad_price_rows,
         count(*) FILTER (price < 0) AS negative_price_rows, """
    + ", ".join(
        f"count(*) FILTER ({c} IS NULL) AS null_{c}, "
        f"{_pct(f'count(*) FILTER ({c} IS NULL)', 'count(*)')} AS null_pct_{c}"
        for c in ["event_time", "event_type", "product_id", "user_id", "price"]
    )
    + " FROM clicks",
    "unknown_event_types": _with(CLICKS)
    + """SELECT DISTINCT event_type FROM clicks
         WHERE event_type NOT IN ('view', 'cart', 'remove_from_cart', 'purchase')
         ORDER BY event_type""",
    "chi_square_contingency": CONTINGENCY + "SELECT * FROM contingency",
    "chi_square_statistic": CHI_SQUARE
    + """SELECT factor, round_even(chi2, 4) AS chi2, round_even(p, 6) AS p_value, dof,
                p < 0.05 AS significant
         FROM tails""",
}

# The same results on other paths: a log stored by day, the sieve, counts observed in passing, bitmaps of days.
ORACLE |= {
    "stored_date_range": ORACLE["filter_date_range"],
    "stored_date_bounds": ORACLE["date_bounds"],
    "remove_many_bots": ORACLE["remove_bots"],
    "run_cleaning_counts": ORACLE["cleaning_report"],
    "activity_cohorts": ORACLE["cohort_active_users"],
    "activity_uniques": KPIS + "SELECT unique_users, unique_products FROM kpis",
}
