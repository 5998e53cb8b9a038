"""The SQL twin of every query that SQL can express, for DuckDB."""

from __future__ import annotations

from storelens.lookups import DOCUMENT_TITLES

# ---- shared views ---------------------------------------------------------------

_ORDERS = """
lines_ AS (
    SELECT l_orderkey, min(l_partkey) AS l_partkey, sum(l_quantity) AS l_quantity, bool_or(l_returnflag = 'R') AS came_back
    FROM lineitem GROUP BY 1
),
sold AS (
    SELECT *, o_orderdate::DATE AS day,
        CASE WHEN o_orderkey % 101 = 0 THEN NULL
             WHEN o_orderkey % 13 = 0 THEN 'cancelled'
             WHEN o_orderdate::DATE >= DATE '2001-07-20' AND o_orderkey % 5 = 0 THEN 'processing'
             WHEN o_orderdate::DATE >= DATE '2001-07-05' AND o_orderkey % 5 = 1 THEN 'shipped'
             WHEN o_orderdate::DATE >= DATE '2001-07-05' AND o_orderkey % 5 = 2 THEN 'in_transit'
             ELSE 'delivered' END AS status
    FROM orders
    LEFT JOIN lines_ ON o_orderkey = l_orderkey
    LEFT JOIN part ON l_partkey = p_partkey
    LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey
),
shipped AS (
    SELECT *, CASE WHEN status = 'delivered' THEN (2 + o_orderkey % 9)::INTEGER END AS days FROM sold
),
filed AS (
    SELECT *, CASE WHEN days IS NOT NULL AND came_back AND (o_orderkey // 3) % 3 = 0
                   THEN day + days + ((o_orderkey // 4) % 20)::INTEGER END AS requested
    FROM shipped
),
o AS (
    SELECT 'ORD-' || repeat('0', greatest(9 - length(o_orderkey::VARCHAR), 0)) || o_orderkey AS order_id,
        day AS order_date,
        p_name AS product,
        p_type AS category,
        l_quantity::INTEGER AS quantity,
        p_retailprice::DECIMAL(18,2) AS unit_price,
        CASE WHEN o_orderkey % 103 <> 0 THEN o_totalprice::DECIMAL(18,2) END AS total,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'credit_card' WHEN '2-HIGH' THEN 'debit_card'
             WHEN '3-MEDIUM' THEN 'digital_wallet' WHEN '4-NOT SPECIFIED' THEN 'bank_transfer'
             WHEN '5-LOW' THEN 'cash_on_delivery' END AS payment_method,
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN (1 + o_orderkey % 12)::INTEGER ELSE 1 END
            AS installments,
        CASE WHEN o_orderkey % 97 <> 0 THEN n_name END AS country,
        r_name AS shipping_zone,
        status AS order_status,
        day + days AS delivery_date,
        days::DOUBLE AS delivery_days,
        requested::DATE AS return_request_date,
        CASE WHEN requested IS NOT NULL THEN
            ['defective_product', 'not_as_described', 'arrived_damaged', 'changed_mind',
             'wrong_size_or_model', 'other_reason'][(l_partkey % 6 + 1)::INTEGER] END AS return_reason,
        CASE WHEN requested IS NOT NULL THEN
            ['approved', 'rejected', 'pending'][(o_orderkey % 3 + 1)::INTEGER] END AS return_status
    FROM filed
),
nc AS (SELECT * FROM o WHERE order_status IS DISTINCT FROM 'cancelled')
"""

_BUCKET = """CASE return_reason WHEN 'not_as_described' THEN 'Product / listing quality'
    WHEN 'defective_product' THEN 'Product / listing quality' WHEN 'arrived_damaged' THEN 'Shipping damage'
    WHEN 'changed_mind' THEN 'Customer choice' WHEN 'wrong_size_or_model' THEN 'Customer choice'
    ELSE 'Other' END"""

# One row per closed week from four weeks before the first order.
_WEEKS = _ORDERS + f""",
bounds AS (
    SELECT min(order_date) AS first_day, max(order_date) AS last_day,
        (date_trunc('week', min(order_date))::DATE + 6) AS first_week,
        (max(order_date) - dayofweek(max(order_date))::INTEGER) AS last_week
    FROM o
),
calendar AS (
    SELECT unnest(generate_series((first_week - 28)::TIMESTAMP, last_week::TIMESTAMP, INTERVAL 7 DAY))::DATE AS week_end
    FROM bounds
),
placed_week AS (
    SELECT date_trunc('week', order_date)::DATE + 6 AS week_end,
        count(*) AS placed,
        count(*) FILTER (order_status = 'cancelled') AS cancelled,
        sum(total) FILTER (order_status = 'cancelled') AS cancelled_value,
        count(*) FILTER (order_status IS DISTINCT FROM 'cancelled') AS orders,
        sum(total) FILTER (order_status IS DISTINCT FROM 'cancelled') AS revenue,
        sum(quantity) FILTER (order_status IS DISTINCT FROM 'cancelled') AS units,
        count(*) FILTER (order_status IS DISTINCT FROM 'cancelled' AND installments > 1) AS instalment_orders,
        sum(delivery_days) FILTER (order_status = 'delivered') AS days_sum,
        count(delivery_days) FILTER (order_status = 'delivered') AS days_known
    FROM o GROUP BY 1
),
filed_week AS (
    SELECT date_trunc('week', return_request_date)::DATE + 6 AS week_end, count(*) AS filed,
        sum(total) AS filed_value,
        count(*) FILTER ({_BUCKET} <> 'Customer choice') AS controllable
    FROM o WHERE return_request_date IS NOT NULL GROUP BY 1
),
counts AS (
    SELECT c.week_end, coalesce(placed, 0) AS placed, coalesce(cancelled, 0) AS cancelled,
        coalesce(cancelled_value, 0) AS cancelled_value, coalesce(orders, 0) AS orders,
        coalesce(revenue, 0) AS revenue, coalesce(units, 0) AS units,
        coalesce(instalment_orders, 0) AS instalment_orders, coalesce(days_sum, 0) AS days_sum,
        coalesce(days_known, 0) AS days_known, coalesce(filed, 0) AS filed,
        coalesce(filed_value, 0) AS filed_value, coalesce(controllable, 0) AS controllable
    FROM calendar c LEFT JOIN placed_week USING (week_end) LEFT JOIN filed_week USING (week_end)
),
weeks AS (
    SELECT *, revenue::DOUBLE AS revenue_now, orders::DOUBLE AS orders_now,
        CASE WHEN orders > 0 THEN revenue::DOUBLE / orders ELSE 0 END AS aov_now,
        CASE WHEN placed > 0 THEN 100 * (cancelled::DOUBLE / placed) ELSE 0 END AS cancel_rate_now,
        CASE WHEN orders > 0 THEN 100 * (filed::DOUBLE / orders) ELSE 0 END AS return_rate_filed_now,
        CASE WHEN days_known > 0 THEN days_sum / days_known END AS avg_delivery_days_now
    FROM counts
),
long AS (
    SELECT week_end, 'revenue' AS metric, revenue_now AS now, NULL::DOUBLE AS numerator, NULL::DOUBLE AS denominator FROM weeks
    UNION ALL SELECT week_end, 'orders', orders_now, NULL, NULL FROM weeks
    UNION ALL SELECT week_end, 'aov', aov_now, revenue::DOUBLE, orders::DOUBLE FROM weeks
    UNION ALL SELECT week_end, 'cancel_rate', cancel_rate_now, cancelled::DOUBLE, placed::DOUBLE FROM weeks
    UNION ALL SELECT week_end, 'return_rate_filed', return_rate_filed_now, filed::DOUBLE, orders::DOUBLE FROM weeks
    UNION ALL SELECT week_end, 'avg_delivery_days', avg_delivery_days_now, days_sum, days_known::DOUBLE FROM weeks
),
history AS (
    SELECT *, lag(now) OVER w AS prev, lag(now, 2) OVER w AS two, lag(now, 3) OVER w AS three, lag(now, 4) OVER w AS four,
        CASE WHEN count(now) OVER f = 4 THEN (sum(now) OVER f) / 4 END AS avg4
    FROM long
    WINDOW w AS (PARTITION BY metric ORDER BY week_end),
           f AS (PARTITION BY metric ORDER BY week_end ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)
),
reported AS (SELECT h.* FROM history h, bounds WHERE week_end >= first_week)
"""


def _money(column: str, name: str) -> str:
    return f"coalesce(sum({column}), 0)::DOUBLE AS {name}"


def _over_orders(select: str) -> str:
    return f"WITH {_ORDERS} {select}"


def _over_weeks(select: str) -> str:
    return f"WITH {_WEEKS} {select}"


def _pct(now: str, before: str) -> str:
    return f"CASE WHEN {before} = 0 THEN 0 ELSE ({now} - {before}) / {before} * 100 END"


def _week(day: str) -> str:
    return f"(date_trunc('week', {day})::DATE + 6)"


def _breakdown(name: str, key: str | None = None, where: str = "true") -> str:
    return _over_orders(f"""
        SELECT {key or name} AS {name}, {_money('total', 'revenue')}, count(order_id) AS orders
        FROM nc WHERE {key or name} IS NOT NULL AND {where} GROUP BY 1""")


_PERIOD = "order_date BETWEEN DATE '1997-02-01' AND DATE '1999-10-31'"


def _top(measure: str, name: str, kind: str, n: int, where: str = "true") -> str:
    return _over_orders(f"""
        SELECT row_number() OVER (ORDER BY v DESC, product, category)::INTEGER AS rank, product, category, v::{kind} AS {name}
        FROM (SELECT product, category, coalesce(sum({measure}), 0) AS v FROM nc WHERE product IS NOT NULL AND {where} GROUP BY 1, 2)
        ORDER BY v DESC, product, category LIMIT {n}""")


def _overview(where: str) -> str:
    return _over_orders(f"""
        SELECT min(order_date) AS first_order_date, max(order_date) AS last_order_date,
            coalesce(sum(total) FILTER (order_status IS DISTINCT FROM 'cancelled'), 0)::DOUBLE AS revenue,
            count(*) FILTER (order_status IS DISTINCT FROM 'cancelled') AS orders,
            round((sum(total) FILTER (order_status IS DISTINCT FROM 'cancelled'))::DOUBLE
                / count(total) FILTER (order_status IS DISTINCT FROM 'cancelled'), 6) AS average_order_value
        FROM o WHERE {where}""")


def _returned(where: str) -> str:
    return _over_orders(f"""
        SELECT count(return_request_date) AS return_requests,
            count(*) FILTER (order_status = 'delivered') AS delivered_orders,
            round(count(return_request_date)::DOUBLE / count(*) FILTER (order_status = 'delivered'), 6)
                AS return_rate_delivered
        FROM o WHERE {where}""")


def _leader(key: str, measure: str, name: str, label: str) -> str:
    return f"SELECT {key}, {label} AS label, {measure} AS {name} FROM nc WHERE {key} IS NOT NULL GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 1"


def _moved(base: str, name: str) -> str:
    change = _pct("now", base)
    return _over_weeks(f"""
        SELECT week_end, metric, round(now, 6) AS value, round({base}, 6) AS {name}, round(d, 6) AS delta_pct, direction,
            CASE WHEN direction <> 'flat' THEN direction =
                CASE WHEN metric IN ('cancel_rate', 'return_rate_filed', 'avg_delivery_days') THEN 'down' ELSE 'up' END
            END AS good
        FROM (SELECT *, CASE WHEN d IS NULL OR abs(d) < 0.05 THEN 'flat' WHEN d > 0 THEN 'up' ELSE 'down' END AS direction
              FROM (SELECT *, {change} AS d FROM reported))""")


def _summary(extra: str = "") -> str:
    return _over_weeks(f"""
        SELECT (week_end - 6)::DATE AS week_start, week_end, metric, round(now, 6) AS value,
            round(numerator, 6) AS numerator, round(denominator, 6) AS denominator,
            round(prev, 6) AS previous, round({_pct('now', 'prev')}, 6) AS vs_previous_pct,
            round(avg4, 6) AS average_4_weeks, round({_pct('now', 'avg4')}, 6) AS vs_average_pct,
            CASE metric WHEN 'revenue' THEN 'sum of total of non-cancelled orders placed in the week'
                WHEN 'orders' THEN 'count of non-cancelled orders placed in the week'
                WHEN 'aov' THEN 'revenue / orders'
                WHEN 'cancel_rate' THEN 'cancelled / all orders placed in the week * 100'
                WHEN 'return_rate_filed' THEN 'return requests filed in the week, any order / orders * 100'
                ELSE 'mean delivery days of delivered orders placed in the week' END AS formula
        FROM reported {extra}""")


def _share(key: str, measure: str, name: str, kind: str) -> str:
    return _over_orders(f"""
        SELECT week_end, {key}, v::{kind} AS {name}, round(100 * (v::DOUBLE / total::DOUBLE), 6) AS share_pct
        FROM (SELECT {_week('order_date')} AS week_end, {key}, coalesce({measure}, 0) AS v,
                     sum({measure}) OVER (PARTITION BY {_week('order_date')}) AS total
              FROM nc GROUP BY 1, 2)
        WHERE {key} IS NOT NULL""")


def _table(key: str, measure: str, name: str, kind: str) -> str:
    return _over_orders(f"""
        SELECT week_end, {key}, is_total, v::{kind} AS {name},
            round(100 * (v::DOUBLE / nullif(max(v) FILTER (is_total) OVER (PARTITION BY week_end), 0)::DOUBLE), 6) AS share_pct
        FROM (SELECT {_week('order_date')} AS week_end, {key}, grouping({key}) = 1 AS is_total, coalesce({measure}, 0) AS v
              FROM nc GROUP BY GROUPING SETS ((week_end, {key}), (week_end)))
        QUALIFY is_total OR {key} IS NOT NULL""")


_ES = """CASE {c} WHEN 'credit_card' THEN 'Tarjeta de crédito' WHEN 'debit_card' THEN 'Tarjeta de débito'
    WHEN 'digital_wallet' THEN 'Billetera digital' WHEN 'bank_transfer' THEN 'Transferencia'
    WHEN 'cash_on_delivery' THEN 'Contra entrega' WHEN 'defective_product' THEN 'Producto defectuoso'
    WHEN 'not_as_described' THEN 'No corresponde a la descripción' WHEN 'changed_mind' THEN 'Arrepentimiento'
    WHEN 'wrong_size_or_model' THEN 'Talla o modelo incorrecto' WHEN 'arrived_damaged' THEN 'Llegó dañado'
    ELSE {c} END"""


def _es(column: str) -> str:
    return _ES.format(c=column)


def _pretty(column: str) -> str:
    words = f"replace({column}, '_', ' ')"
    return f"upper({words}[1]) || lower({words}[2:])"


_BACKLOG_WEEK = """
    SELECT r.week_end AS cutoff,
        count(*) FILTER (transit) AS open_orders,
        count(*) FILTER (transit AND r.week_end - order_date > 10) AS open_aged,
        coalesce(max(r.week_end - order_date) FILTER (transit), 0)::INTEGER AS oldest_open_days,
        count(*) FILTER (waiting) AS processing_orders,
        count(*) FILTER (waiting AND r.week_end - order_date > 2) AS processing_aged
    FROM (SELECT DISTINCT week_end FROM reported) r
    LEFT JOIN (SELECT order_date, order_status IN ('shipped', 'in_transit') AS transit,
                      order_status = 'processing' AS waiting FROM o) p
        ON (transit OR waiting) AND order_date <= r.week_end
    GROUP BY 1
"""

_RUNS = """
runs AS (
    SELECT event_id::VARCHAR AS id, (event_id // 4)::VARCHAR AS trace_id, event_type AS name,
        event_id = (event_id // 4) * 4 AS is_root, ts AS start_time, value, user_id AS total_tokens, event_type, props,
        regexp_replace(props, '["{}]', '', 'g') AS asked
    FROM events
),
tools AS (
    SELECT trace_id, name AS tool, count(*) AS calls FROM runs WHERE NOT is_root GROUP BY 1, 2
),
traced AS (
    SELECT trace_id, start_time AS ts, asked AS question FROM runs
    WHERE is_root AND event_type <> 'error' {window}
)
"""


def _runs(window: str) -> str:
    return _RUNS.replace("{window}", window)


_TOOL = """CASE event_type WHEN 'click' THEN 'top_products' WHEN 'view' THEN 'sales_overview'
    WHEN 'purchase' THEN 'returns_report' WHEN 'signup' THEN 'order_lookup' ELSE event_type END"""
_TOPIC = """CASE tool WHEN 'top_products' THEN 'Sales & products' WHEN 'sales_overview' THEN 'Sales & products'
    WHEN 'returns_report' THEN 'Returns' WHEN 'order_lookup' THEN 'Order lookup' ELSE 'Other' END"""
_RECENT = "AND start_time >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY"
_INTERACTIONS = f"""WITH {_runs(_RECENT)},
everything AS (
    SELECT ts, props AS question, {_TOOL} AS tool, 1::BIGINT AS calls FROM events
    UNION ALL
    SELECT ts, question, tool, calls FROM traced LEFT JOIN tools USING (trace_id)
)
"""
_VERDICTS = """
verdicts AS (
    SELECT source AS category,
        CASE WHEN quality = 1 AND toxic = 0 THEN 'PASS' WHEN quality = 1 THEN 'PARTIAL'
             WHEN toxic = 0 THEN 'FAIL' ELSE 'ERROR' END AS verdict
    FROM labels JOIN documents USING (doc_id)
)
"""

_SECTIONS = r"""
lines AS (
    SELECT doc_id, unnest(range(1, len(parts) + 1)) AS k, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
),
pages_ AS (
    SELECT doc_id, k, ((k - 1) // 10 + 1)::INTEGER AS page_no,
        CASE WHEN k % 4 = 2 THEN k || '. ' || line ELSE line END AS line
    FROM lines
),
flagged AS (
    SELECT *, k > (page_no - 1) * 10 + 1
        AND regexp_matches(
            line || chr(10) || coalesce(lead(line) OVER (PARTITION BY doc_id, page_no ORDER BY k), ''),
            '^\d{1,2}(?:\.\d{1,2})?\.?\s+[A-ZÁÉÍÓÚÑ¿«"]') AS opens
    FROM pages_
),
numbered AS (
    SELECT *, sum(opens::INTEGER) OVER (PARTITION BY doc_id, page_no ORDER BY k) AS pos FROM flagged
),
fragments AS (
    SELECT doc_id, page_no, pos, trim(string_agg(line, chr(10) ORDER BY k), chr(32) || chr(9) || chr(10) || chr(13)) AS fragment
    FROM numbered GROUP BY 1, 2, 3
),
headed AS (
    SELECT *, nullif(trim(regexp_extract(fragment, '^(\d{1,2}(?:\.\d{1,2})?\.?\s+[^\n]{3,80})', 1)), '') AS heading
    FROM fragments WHERE length(fragment) >= 80
),
carried AS (
    SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER (
        PARTITION BY doc_id ORDER BY page_no, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        'Introducción') AS section
    FROM headed
)
"""

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(13)"

# Bodies over the chunk size are cut at the coarsest mark they hold, parts that are still too
# long at a finer one; neighbouring parts are then packed into windows, which overlap.
_CHUNKS = rf"""
bodies AS (
    SELECT doc_id, page_no, pos, section, CASE WHEN heading IS NULL THEN section || chr(10) || fragment ELSE fragment END AS body
    FROM carried
),
marks AS (SELECT [chr(10) || chr(10), chr(10), '. ', ' ', ''] AS marks),
tree AS (
    SELECT doc_id, page_no, pos, '' AS path, body AS part, 1 AS finest FROM bodies WHERE length(body) > 1000
    UNION ALL
    SELECT doc_id, page_no, pos, path || lpad(unnest(range(len(parts)))::VARCHAR, 7, '0') || '/', unnest(parts), (mark + 1)::INTEGER
    FROM (
        SELECT *, list_filter(list_transform(string_split(part, marks[mark]), lambda p, i: CASE WHEN i = 1 THEN p ELSE marks[mark] || p END), lambda p: p <> '') AS parts
        FROM (
            SELECT *, list_filter(range(finest, 6), lambda j: marks[j] = '' OR contains(part, marks[j]))[1] AS mark
            FROM tree, marks WHERE finest <= 5 AND (path = '' OR length(part) >= 1000)
        )
    )
),
leaves AS (
    SELECT *, sum(long::INTEGER) OVER (PARTITION BY doc_id, page_no, pos, parent ORDER BY path) AS run
    FROM (SELECT *, left(path, -8) AS parent, length(part) >= 1000 AND finest <= 5 AS long FROM tree WHERE path <> '')
),
packs AS (
    SELECT row_number() OVER () AS pack, *, [0] || list_transform(range(1, len(sizes) + 1), lambda k: list_sum(sizes[1:k])::BIGINT) AS upto
    FROM (
        SELECT doc_id, page_no, pos, parent, run, min(path) AS first_path, list(part ORDER BY path) AS parts, list(length(part) ORDER BY path) AS sizes
        FROM leaves WHERE NOT long GROUP BY 1, 2, 3, 4, 5
    )
),
windows AS (
    SELECT pack, 0::BIGINT AS low, 0::BIGINT AS next, NULL::BIGINT AS from_, NULL::BIGINT AS to_ FROM packs
    UNION ALL
    SELECT pack, CASE WHEN over THEN moved ELSE low END, next + 1, CASE WHEN over THEN low END, CASE WHEN over THEN next END
    FROM (
        SELECT pack, low, next, upto[next + 2] - upto[low + 1] > 1000 AND next > low AS over,
            list_filter(range(low, next + 1), lambda l: l = next OR (upto[next + 1] - upto[l + 1] <= 150 AND upto[next + 2] - upto[l + 1] <= 1000))[1] AS moved
        FROM windows JOIN packs USING (pack) WHERE next < len(parts)
    )
),
pieces AS (
    SELECT doc_id, page_no, pos, first_path, until, trim(array_to_string(parts[since + 1:until], ''), {_BLANKS}) AS piece
    FROM packs JOIN (
        SELECT pack, from_ AS since, to_ AS until FROM windows WHERE from_ IS NOT NULL
        UNION ALL SELECT pack, low, next FROM windows JOIN packs USING (pack) WHERE next = len(parts)
    ) USING (pack)
),
chunks AS (
    SELECT doc_id, page_no, pos, row_number() OVER (PARTITION BY doc_id, page_no, pos ORDER BY first_path, until) - 1 AS n, section,
        CASE WHEN starts_with(piece, section) THEN piece ELSE section || chr(10) || piece END AS text
    FROM pieces JOIN bodies USING (doc_id, page_no, pos) WHERE piece <> ''
    UNION ALL SELECT doc_id, page_no, pos, 0, section, body FROM bodies WHERE length(body) <= 1000
)
"""

_RANKED = """
stats AS (
    SELECT i, avg(x::DOUBLE) AS mean, min(x)::DOUBLE AS low, max(x)::DOUBLE AS high
    FROM (SELECT unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY 1
),
asked AS (
    SELECT 'mean' AS question, list(mean ORDER BY i) AS q FROM stats
    UNION ALL SELECT 'low', list(low ORDER BY i) FROM stats
    UNION ALL SELECT 'high', list(high ORDER BY i) FROM stats
),
ranked AS (
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, passage_id)::INTEGER AS rank
        FROM (SELECT question, vec_id AS passage_id, round(list_inner_product(embedding::DOUBLE[], q), 9) AS score
              FROM embeddings, asked {corpus}))
    WHERE rank <= 5
)
"""



def _ranked(corpus: str) -> str:
    return _RANKED.replace("{corpus}", corpus)


ORACLES: dict[str, str] = {
    # ---- cleaning and labels
    "clean_money": """
        SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
                                THEN o_totalprice::DECIMAL(18,2)::DOUBLE END AS total
        FROM orders""",
    "parse_dates": """
        SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate::DATE END AS order_date FROM orders""",
    "parse_dates_strict": """
        SELECT o_orderkey, o_orderdate::DATE AS order_date FROM orders WHERE o_orderpriority <> '5-LOW'""",
    "clean_delivery_days": """
        SELECT o_orderkey, CASE WHEN o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW')
                                THEN (o_orderkey % 30)::INTEGER END AS delivery_days
        FROM orders""",
    "localized_labels": _over_orders(f"""
        SELECT order_id, {_es('payment_method')} AS payment_label, {_es('return_reason')} AS reason_label FROM o"""),
    "pretty_labels": _over_orders(f"""
        SELECT order_id, {_pretty('payment_method')} AS payment_label, {_pretty('return_reason')} AS reason_label FROM o"""),
    # ---- filters
    "orders_in_period": _over_orders("""
        SELECT order_id, order_date, total::DOUBLE AS total FROM o
        WHERE order_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"""),
    "non_cancelled": _over_orders("SELECT order_id, order_status, total::DOUBLE AS total FROM nc"),
    # ---- sales
    "sales_overview": _overview("true"),
    "sales_overview_of_period": _overview(_PERIOD),
    "orders_by_status_counts": _over_orders("""
        SELECT order_status, count(*) AS orders FROM o WHERE order_status IS NOT NULL GROUP BY 1"""),
    "top_products_revenue": _top("total", "revenue", "DOUBLE", 10),
    "top_products_units": _top("quantity", "units", "BIGINT", 10),
    "top_products_of_period": _top("total", "revenue", "DOUBLE", 5, _PERIOD),
    "sales_by_country_since": _breakdown("country", where="order_date >= DATE '2000-01-01'"),
    "sales_by_month": _breakdown("month", "strftime(order_date, '%Y-%m')"),
    "sales_by_country": _breakdown("country"),
    "sales_by_category": _breakdown("category"),
    "sales_by_payment_method": _breakdown("payment_method"),
    "sales_by_shipping_zone": _breakdown("shipping_zone"),
    # ---- returns
    "returns_report": _returned("true"),
    "returns_report_of_period": _returned(_PERIOD),
    "return_reasons_top5": _over_orders("""
        SELECT return_reason, count(*) AS requests FROM o
        WHERE return_request_date IS NOT NULL AND return_reason IS NOT NULL
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""),
    "return_status_counts": _over_orders("""
        SELECT return_status, count(*) AS requests FROM o
        WHERE return_request_date IS NOT NULL AND return_status IS NOT NULL GROUP BY 1"""),
    "late_returns": _over_orders("""
        SELECT count(*) AS return_requests, count(*) FILTER (late > 10) AS late_requests,
            round(count(*) FILTER (late > 10)::DOUBLE / count(*), 6) AS late_share,
            round(avg(late) FILTER (late > 10), 6) AS mean_days_late
        FROM (SELECT return_request_date - delivery_date AS late FROM o WHERE return_request_date IS NOT NULL)"""),
    # ---- order desk
    "order_lookup": _over_orders("""
        SELECT * REPLACE (unit_price::DOUBLE AS unit_price, total::DOUBLE AS total) FROM o
        WHERE order_id = 'ORD-000000007'"""),
    "list_orders": _over_orders("""
        SELECT order_id, order_date, country, product, total::DOUBLE AS total,
            ((SELECT max(order_date) FROM o) - order_date)::INTEGER AS days_since_order,
            (SELECT count(*) FROM o WHERE order_status = 'processing') AS status_total,
            (SELECT count(*) FROM o WHERE order_status = 'processing') AS match_total
        FROM o WHERE order_status = 'processing' ORDER BY order_date DESC, order_id LIMIT 50"""),
    "list_orders_in_country": _over_orders("""
        SELECT order_id, order_date, country, product, total::DOUBLE AS total,
            ((SELECT max(order_date) FROM o) - order_date)::INTEGER AS days_since_order,
            (SELECT count(*) FROM o WHERE order_status = 'cancelled') AS status_total,
            (SELECT count(*) FROM o WHERE order_status = 'cancelled' AND country = 'NATION_3') AS match_total
        FROM o WHERE order_status = 'cancelled' AND country = 'NATION_3'
        ORDER BY order_date DESC, order_id LIMIT 20"""),
    # ---- weekly report
    "last_closed_week": _over_weeks("SELECT last_week AS week_end FROM bounds"),
    "week_snap": _over_weeks(f"""
        SELECT order_id, {_week('order_date')} AS week_end, least({_week('order_date')}, last_week) AS report_week
        FROM o, bounds"""),
    "weekly_metrics": _over_weeks("""
        SELECT (week_end - 6)::DATE AS week_start, week_end, revenue::DOUBLE AS revenue, orders, round(aov_now, 6) AS aov,
            placed, cancelled, cancelled_value::DOUBLE AS cancelled_value, round(cancel_rate_now, 6) AS cancel_rate,
            filed, round(return_rate_filed_now, 6) AS return_rate_filed,
            round(avg_delivery_days_now, 6) AS avg_delivery_days, units::BIGINT AS units,
            round(CASE WHEN orders > 0 THEN units::DOUBLE / orders END, 6) AS units_per_order,
            round(CASE WHEN orders > 0 THEN 100 * (instalment_orders::DOUBLE / orders) ELSE 0 END, 6) AS instalment_share
        FROM weeks, bounds WHERE week_end >= first_week"""),
    "weekly_deltas": _moved("prev", "previous"),
    "weekly_vs_avg4": _moved("avg4", "avg4"),
    "weekly_series": _over_weeks("""
        SELECT week_end, metric, round(four, 6) AS four_back, round(three, 6) AS three_back, round(two, 6) AS two_back,
            round(prev, 6) AS one_back, round(now, 6) AS current
        FROM reported"""),
    "decline_streak": _over_weeks("""
        SELECT week_end,
            (CASE WHEN NOT now < prev THEN 0 WHEN NOT prev < two THEN 1 WHEN NOT two < three THEN 2
                  WHEN NOT three < four THEN 3 ELSE 4 END)::INTEGER AS streak,
            (CASE WHEN NOT prev < two THEN 0 WHEN NOT two < three THEN 1 WHEN NOT three < four THEN 2 ELSE 3 END)::INTEGER
                AS previous_streak,
            prev <> 0 AND now > prev AND prev < two AS rebound
        FROM reported WHERE metric = 'revenue'"""),
    "weekly_summary": _summary(),
    "report_summary": _summary("WHERE week_end = DATE '1999-07-04'"),
    "report_summary_early": _over_weeks("""
        SELECT DATE '1979-12-31' AS week_start, DATE '1980-01-06' AS week_end, metric,
            CASE WHEN metric <> 'avg_delivery_days' THEN 0::DOUBLE END AS value,
            CASE WHEN metric NOT IN ('revenue', 'orders') THEN 0::DOUBLE END AS numerator,
            CASE WHEN metric NOT IN ('revenue', 'orders') THEN 0::DOUBLE END AS denominator,
            CASE WHEN metric <> 'avg_delivery_days' THEN 0::DOUBLE END AS previous,
            CASE WHEN metric <> 'avg_delivery_days' THEN 0::DOUBLE END AS vs_previous_pct,
            CASE WHEN metric <> 'avg_delivery_days' THEN 0::DOUBLE END AS average_4_weeks,
            CASE WHEN metric <> 'avg_delivery_days' THEN 0::DOUBLE END AS vs_average_pct,
            formula
        FROM (SELECT unnest(['revenue', 'orders', 'aov', 'cancel_rate', 'return_rate_filed', 'avg_delivery_days']) AS metric,
                  unnest(['sum of total of non-cancelled orders placed in the week',
                          'count of non-cancelled orders placed in the week', 'revenue / orders',
                          'cancelled / all orders placed in the week * 100',
                          'return requests filed in the week, any order / orders * 100',
                          'mean delivery days of delivered orders placed in the week']) AS formula), bounds
        WHERE DATE '1980-01-06' < first_week"""),
    "weekly_summary_text": _over_weeks("""
        SELECT week_end, metric, CASE metric WHEN 'revenue' THEN format('${:,.0f}', now)
            WHEN 'orders' THEN format('{:,.0f}', now) WHEN 'aov' THEN format('${:,.2f}', now)
            WHEN 'avg_delivery_days' THEN format('{:.1f} days', now) ELSE format('{:.1f}%', now) END AS text
        FROM reported"""),
    "cancellations_by_country": _over_orders(f"""
        SELECT {_week('order_date')} AS week_end, country, count(order_id) AS cancelled, {_money('total', 'cancelled_value')}
        FROM o WHERE order_status = 'cancelled' AND country IS NOT NULL GROUP BY 1, 2"""),
    "cancellation_concentration": _over_orders(f"""
        SELECT week_end, country, cancelled, week_cancelled::BIGINT AS week_cancelled,
            round(cancelled::DOUBLE / week_cancelled, 6) AS share, cancelled::DOUBLE / week_cancelled >= 0.5 AS concentrated
        FROM (SELECT *, sum(cancelled) OVER (PARTITION BY week_end) AS week_cancelled,
                  row_number() OVER (PARTITION BY week_end ORDER BY (country IS NULL), cancelled DESC, country) AS place
              FROM (SELECT {_week('order_date')} AS week_end, country, count(*) AS cancelled
                    FROM o WHERE order_status = 'cancelled' GROUP BY 1, 2))
        WHERE place = 1 AND country IS NOT NULL"""),
    "cancellations_rollup": _over_orders(f"""
        SELECT week_end, country, grouping(country) = 1 AS is_total, count(*) AS cancelled, {_money('total', 'cancelled_value')}
        FROM (SELECT {_week('order_date')} AS week_end, country, total FROM o WHERE order_status = 'cancelled')
        GROUP BY GROUPING SETS ((week_end, country), (week_end)) HAVING is_total OR country IS NOT NULL"""),
    "return_buckets": _over_orders(f"""
        SELECT {_week('return_request_date')} AS week_end, {_BUCKET} AS bucket, count(*) AS requests
        FROM o WHERE return_request_date IS NOT NULL GROUP BY 1, 2"""),
    "returns_controllable": _over_weeks("""
        SELECT week_end, filed, controllable, filed_value::DOUBLE AS value_at_risk
        FROM counts, bounds WHERE week_end >= first_week"""),
    "weekly_return_reasons": _over_orders(f"""
        SELECT {_week('return_request_date')} AS week_end, return_reason, count(*) AS requests
        FROM o WHERE return_reason IS NOT NULL GROUP BY 1, 2"""),
    "weekly_return_status": _over_orders(f"""
        SELECT {_week('return_request_date')} AS week_end, return_status, count(*) AS requests
        FROM o WHERE return_status IS NOT NULL GROUP BY 1, 2"""),
    "weekly_top5": _over_orders(f"""
        SELECT week_end, rank::INTEGER AS rank, product, v::DOUBLE AS revenue
        FROM (SELECT *, row_number() OVER (PARTITION BY week_end ORDER BY v DESC, product) AS rank
              FROM (SELECT {_week('order_date')} AS week_end, product, coalesce(sum(total), 0) AS v FROM nc WHERE product IS NOT NULL GROUP BY 1, 2))
        WHERE rank <= 5"""),
    "repeat_return_products": _over_orders(f"""
        SELECT week_end, product, requests
        FROM (SELECT {_week('return_request_date')} AS week_end, product, count(*) AS requests
              FROM o WHERE return_request_date IS NOT NULL AND product IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)
        SEMI JOIN (SELECT week_end, product FROM (
                SELECT *, row_number() OVER (PARTITION BY week_end ORDER BY v DESC, product) AS rank
                FROM (SELECT {_week('order_date')} AS week_end, product, coalesce(sum(total), 0) AS v FROM nc WHERE product IS NOT NULL GROUP BY 1, 2))
            WHERE rank <= 5) USING (week_end, product)"""),
    "daily_sales_vs_prev": _over_weeks("""
        , days AS (
            SELECT unnest(generate_series((first_week - 6)::TIMESTAMP, last_week::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day
            FROM bounds),
        daily AS (SELECT order_date, sum(total)::DOUBLE AS revenue FROM nc GROUP BY 1)
        SELECT (date_trunc('week', day)::DATE + 6) AS week_end, day, strftime(day, '%a %d') AS label,
            coalesce(a.revenue, 0) AS revenue, coalesce(b.revenue, 0) AS previous_revenue
        FROM days LEFT JOIN daily a ON a.order_date = day LEFT JOIN daily b ON b.order_date = day - 7"""),
    "weekly_category_share": _share("category", "sum(total)", "revenue", "DOUBLE"),
    "weekly_country_share": _share("country", "sum(total)", "revenue", "DOUBLE"),
    "weekly_payment_share": _share("payment_method", "count(*)", "orders", "BIGINT"),
    "weekly_country_table": _table("country", "sum(total)", "revenue", "DOUBLE"),
    "weekly_payment_table": _table("payment_method", "count(*)", "orders", "BIGINT"),
    "backlog": _over_weeks(f"SELECT * FROM ({_BACKLOG_WEEK}) WHERE cutoff = (SELECT last_week FROM bounds)"),
    "weekly_backlog": _over_weeks(_BACKLOG_WEEK),
    "weekly_alerts": _over_weeks(f"""
        , b AS ({_BACKLOG_WEEK}),
        w AS (SELECT weeks.* FROM weeks, bounds WHERE week_end >= first_week)
        SELECT week_end, 'cancellations' AS alert, round(cancel_rate_now, 6) AS value, 8.0::DOUBLE AS threshold,
            cancel_rate_now > 8 AS fired, cancelled AS cases, placed AS out_of FROM w
        UNION ALL
        SELECT week_end, 'returns', round(return_rate_filed_now, 6), 10.0, return_rate_filed_now > 10, controllable, filed FROM w
        UNION ALL SELECT cutoff, 'transit_overdue', open_aged, 0, true, open_aged, open_orders FROM b WHERE open_aged > 0
        UNION ALL
        SELECT cutoff, 'processing_overdue', processing_aged, 0, true, processing_aged, processing_orders
        FROM b WHERE processing_aged > 0"""),
    "report_audit": _over_weeks("""
        SELECT week_end, metric, value AS report_value, value AS audit_value, true AS matches
        FROM (SELECT week_end, unnest(['revenue', 'orders', 'cancelled', 'filed']) AS metric,
                  unnest([revenue::DOUBLE, orders::DOUBLE, cancelled::DOUBLE, filed::DOUBLE]) AS value
              FROM counts, bounds WHERE week_end >= first_week)"""),
    # ---- charts
    "chart_monthly_sales": _over_orders(f"""
        SELECT strftime(order_date, '%Y-%m') AS month, {_money('total', 'revenue')} FROM nc GROUP BY 1"""),
    "chart_monthly_peak_low": _over_orders("""
        , m AS (SELECT strftime(order_date, '%Y-%m') AS month, sum(total)::DOUBLE AS revenue FROM nc GROUP BY 1)
        SELECT p.month AS peak_month, p.revenue AS peak_revenue, l.month AS low_month, l.revenue AS low_revenue
        FROM (SELECT * FROM m ORDER BY revenue DESC, month LIMIT 1) p, (SELECT * FROM m ORDER BY revenue, month LIMIT 1) l"""),
    "chart_top_products": _over_orders(f"""
        SELECT product, {_money('total', 'revenue')} FROM nc WHERE product IS NOT NULL GROUP BY 1 ORDER BY sum(total) DESC, product LIMIT 15"""),
    "chart_returns_by_reason": _over_orders(f"""
        SELECT return_reason, {_es('return_reason')} AS label, count(*) AS requests FROM nc
        WHERE return_reason IS NOT NULL GROUP BY 1, 2"""),
    "chart_payment_share": _over_orders(f"""
        SELECT payment_method, {_es('payment_method')} AS label, count(*) AS orders,
            round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share
        FROM nc WHERE payment_method IS NOT NULL GROUP BY 1, 2"""),
    "chart_delivery_hist": _over_orders("""
        SELECT d.days::INTEGER AS days, count(delivery_days) AS orders
        FROM (SELECT unnest(range(min(delivery_days)::BIGINT, max(delivery_days)::BIGINT + 1)) AS days FROM nc) d
        LEFT JOIN nc ON delivery_days::BIGINT = d.days GROUP BY 1"""),
    "chart_delivery_stats": _over_orders("""
        SELECT round(avg(delivery_days), 6) AS mean_days, median(delivery_days)::DOUBLE AS median_days FROM nc"""),
    "chart_sales_by_country": _over_orders(f"""
        SELECT country, country AS label, {_money('total', 'revenue')} FROM nc WHERE country IS NOT NULL GROUP BY 1, 2"""),
    "chart_sales_by_category": _over_orders(f"""
        SELECT category, {_es('category')} AS label, {_money('total', 'revenue')} FROM nc WHERE category IS NOT NULL GROUP BY 1, 2"""),
    "chart_top_product": _over_orders(
        "SELECT product, sum(total)::DOUBLE AS revenue FROM nc WHERE product IS NOT NULL GROUP BY 1 ORDER BY sum(total) DESC, 1 LIMIT 1"),
    "chart_top_return_reason": _over_orders(_leader("return_reason", "count(*)", "requests", "return_reason")),
    "chart_top_payment_method": _over_orders("""
        SELECT payment_method, payment_method AS label, count(*) AS orders,
            round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share
        FROM nc WHERE payment_method IS NOT NULL GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 1"""),
    "chart_top_country": _over_orders(_leader("country", "sum(total)::DOUBLE", "revenue", "country")),
    "chart_top_category": _over_orders(_leader("category", "sum(total)::DOUBLE", "revenue", _es("category"))),
    # ---- logs and traces
    "trace_archive": f"""WITH {_runs(_RECENT)}
        SELECT id, name, start_time, round(value, 6) AS latency_s, total_tokens,
            CASE WHEN event_type = 'error' THEN 'failed: ' || asked END AS error,
            CASE WHEN event_type <> 'error' THEN left('{{''messages'': [{{''content'': ''' || asked
                || '\\n\\n[System note: reply in the language of the question.]''}}]}}', 500) END AS input,
            left(props, 500) AS output
        FROM runs WHERE is_root {_RECENT}""",
    "trace_tools": f"""WITH {_runs('')}
        SELECT trace_id, name, tool, calls FROM runs LEFT JOIN tools USING (trace_id) WHERE is_root""",
    "trace_questions": f"""WITH {_runs('')} SELECT ts, question FROM traced""",
    "interactions_union": _INTERACTIONS + "SELECT ts, question, tool, calls FROM everything",
    "team_questions": f"""WITH {_runs(_RECENT)}
        SELECT question, count(*) AS times
        FROM (SELECT props AS question FROM events UNION ALL SELECT question FROM traced)
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
    "team_topics": _INTERACTIONS + f"""
        SELECT {_TOPIC} AS topic, sum(calls)::BIGINT AS calls, round(sum(calls)::DOUBLE / sum(sum(calls)) OVER (), 6) AS share
        FROM everything WHERE tool IS NOT NULL GROUP BY 1""",
    "interaction_count": f"""WITH {_runs(_RECENT)}
        SELECT (SELECT count(*) FROM events) + (SELECT count(*) FROM traced) AS interactions""",
    "token_usage": """
        SELECT conv_id AS interaction_id,
            coalesce(sum(length(text)) FILTER (role = 'user'), 0)::BIGINT AS input_tokens,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS output_tokens,
            coalesce(sum(length(text)) FILTER (role IN ('user', 'assistant')), 0)::BIGINT AS total_tokens
        FROM conversations GROUP BY 1""",
    "content_text": """
        SELECT conv_id, turn, CASE
            WHEN role = 'assistant' THEN trim(text || '{end}', chr(32) || chr(9) || chr(10) || chr(13))
            WHEN turn = 2 THEN '["{' || length(text) || '}", 2]' ELSE text END AS text
        FROM conversations""",
    # ---- evaluation
    "parse_verdicts": """
        WITH replies AS (
            SELECT doc_id, quality = 1 AS good, toxic = 1 AS bad,
                CASE WHEN doc_id % 13 = 0 THEN 'MAYBE' WHEN quality = 1 AND toxic = 0 THEN 'PASS'
                     WHEN quality = 1 THEN 'PARTIAL' ELSE 'FAIL' END AS said
            FROM labels
        ),
        shown AS (
            SELECT *, '{"verdict":"' || said || '","reason":"doc ' || doc_id || '"}' AS body FROM replies
        ),
        read AS (
            SELECT *, CASE WHEN NOT good AND bad THEN 'cannot say: ' || body
                           WHEN good AND doc_id % 7 = 0 THEN body || ' {"verdict":"FAIL"}'
                           WHEN good AND doc_id % 11 = 0 THEN replace(body, '"', chr(39)) END AS unreadable
            FROM shown
        )
        SELECT doc_id,
            CASE WHEN unreadable IS NOT NULL OR said = 'MAYBE' THEN 'NEEDS_REVIEW' ELSE said END AS verdict,
            CASE WHEN unreadable IS NOT NULL THEN 'judge error: ' || left(unreadable, 60)
                 WHEN said = 'MAYBE' THEN 'unparseable judge reply: ' || left(body, 60)
                 ELSE 'doc ' || doc_id END AS reason
        FROM read""",
    "verdict_counts": f"""WITH {_VERDICTS}
        SELECT v.verdict, count(r.verdict) AS answers,
            round(count(r.verdict)::DOUBLE / (SELECT count(*) FROM verdicts), 6) AS share
        FROM (SELECT unnest(['PASS', 'PARTIAL', 'FAIL', 'ERROR', 'NEEDS_REVIEW']) AS verdict) v
        LEFT JOIN verdicts r USING (verdict) GROUP BY 1""",
    "pass_by_category": f"""WITH {_VERDICTS}
        SELECT category, count(*) FILTER (verdict = 'PASS') AS passed, count(*) AS answers FROM verdicts GROUP BY 1""",
    # ---- passages
    "section_fragments": f"""WITH {_SECTIONS}
        SELECT doc_id::VARCHAR AS doc_stem, page_no, section,
            CASE WHEN heading IS NULL THEN section || chr(10) || fragment ELSE fragment END AS body
        FROM carried""",
    "read_orders": """
        SELECT doc_id, lang, '"' || coalesce(text, '') || '",' || chr(10) || '"' AS cell FROM documents""",
    "read_pages": """
        SELECT doc_id, true AS in_order, replace(coalesce(text, ''), chr(12), ' ') AS text FROM documents""",
    "policy_chunks": f"""WITH RECURSIVE {_SECTIONS}, {_CHUNKS}
        SELECT doc_id || '#' || page_no || '#' || pos || '#' || n AS passage_id, text, doc_id::VARCHAR AS title, section, page_no AS page_label
        FROM chunks""",
    "doc_titles": f"""
        SELECT doc_id, CASE WHEN n % 3 = 0 THEN [{', '.join("'" + DOCUMENT_TITLES[k].replace("'", "''") + "'" for k in sorted(DOCUMENT_TITLES))}][
            (n % {len(DOCUMENT_TITLES)} + 1)::INTEGER] ELSE source END AS title
        FROM (SELECT *, try_cast(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS n FROM documents)""",
    "encoded_documents": """
        WITH counts AS (
            SELECT doc_id, [(length(text) - length(replace(text, c, '')))::DOUBLE for c in ['a', 'e', 'i', 'o', 'u']] || [1::DOUBLE] AS v
            FROM documents
        )
        SELECT doc_id, (unnest(range(6)))::INTEGER AS i, round((unnest(v) / sqrt(list_dot_product(v, v)))::FLOAT::DOUBLE, 4) AS x FROM counts""",
    "fixed_window_chunks": """
        SELECT doc_id, start::INTEGER AS start, substring(text, start + 1, 1000) AS text
        FROM (SELECT doc_id, text, unnest(range(0, length(text), 850)) AS start FROM documents)""",
    "vector_topk": f"""WITH {_ranked('')}
        SELECT question, rank, passage_id, round(score, 6) AS score FROM ranked""",
    "vector_topk_of_mixed": f"""WITH {_ranked('WHERE vec_id % 3 <> 0')}
        SELECT question, rank, passage_id, round(score, 6) AS score FROM ranked""",
    "format_passages": f"""WITH {_ranked('WHERE vec_id IN (SELECT doc_id FROM documents)')}
        SELECT question, string_agg('[' || source || ' — p. ' || CASE WHEN lang <> 'en' THEN lang ELSE '?' END || ']'
            || chr(10) || trim(text, chr(32) || chr(9) || chr(10) || chr(13)),
            chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS answer
        FROM ranked JOIN documents ON doc_id = passage_id GROUP BY 1""",
    # ---- streams
    "stream_topic_windows": f"""
        SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, topic, count(*) AS calls
        FROM (SELECT {_TOPIC} AS topic,
                  unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY))
                      AS window_start
              FROM (SELECT ts, {_TOOL} AS tool FROM events))
        GROUP BY ALL""",
    "stream_closed_weeks": """
        SELECT week_end, coalesce(sum(total) FILTER (NOT gone), 0)::DOUBLE AS revenue, count(*) FILTER (NOT gone) AS orders,
            count(*) AS placed, count(*) FILTER (gone) AS cancelled, coalesce(sum(units) FILTER (NOT gone), 0)::BIGINT AS units
        FROM (SELECT date_trunc('week', o_orderdate)::DATE + 6 AS week_end, o_totalprice::DECIMAL(18,2) AS total,
                  o_orderstatus = 'P' AS gone, units
              FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity)::INTEGER AS units FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
        WHERE week_end + 1 <= (SELECT max(o_orderdate) - INTERVAL 1 DAY FROM orders)
        GROUP BY 1""",
    # ---- stores
    "chunk_store": f"""WITH RECURSIVE {_SECTIONS}, {_CHUNKS}
        SELECT doc_id || '#' || page_no || '#' || pos || '#' || n AS passage_id, section, text FROM chunks""",
    "interaction_store": f"""
        SELECT date_trunc('second', ts) AS ts, props AS question, {_TOOL} AS tool, 0::BIGINT AS total_tokens FROM events""",
    "gold_store": """
        SELECT item_id::INTEGER AS id, 'en' AS lang, 'benchmark' AS category, text AS question, NULL::VARCHAR AS expected FROM benchmark""",
    "verdict_store": f"""WITH {_VERDICTS}
        SELECT 'second' AS run_id, category, verdict, count(*) AS answers FROM verdicts GROUP BY ALL
        UNION ALL SELECT 'first', category, verdict, count(*) FROM verdicts WHERE verdict = 'PASS' GROUP BY ALL""",
    "search_policies": """
        WITH counts AS (
            SELECT *, [(length(text) - length(replace(text, c, '')))::DOUBLE for c in ['a', 'e', 'i', 'o', 'u']] || [1::DOUBLE] AS v FROM documents
        ),
        asked AS (SELECT [1, 2, 1, 1, 2, 1]::DOUBLE[] AS q),
        scored AS (
            SELECT *, round(list_dot_product([(x / sqrt(list_dot_product(v, v)))::FLOAT::DOUBLE for x in v], [x / sqrt(list_dot_product(q, q)) for x in q]), 9) AS score
            FROM counts, asked
        ),
        ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored)
        SELECT 'a e i o u' AS question, string_agg('[' || source || ' — p. ' || CASE WHEN lang <> 'en' THEN lang ELSE '?' END || ']'
            || chr(10) || trim(text, chr(32) || chr(9) || chr(10) || chr(13)),
            chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS answer
        FROM ranked WHERE rank <= 3""",
}
