"""Read-only SQL: the guarded console and the shapes of SELECT that pass it."""

from __future__ import annotations

from ..operators import select as S
from . import inputs as I
from .inputs import sql
from .registry import register

STAR = "region nation customer supplier part orders lineitem events".split()


def _views(spark, sf) -> None:
    S.register_views({name: I.table(spark, sf, name) for name in STAR})


@register("list_tables", sql("SELECT table_name, source, page, label AS sheet FROM star_tabs", "star_tabs"))
def list_tables(spark, sf):
    return S.list_tables(I.knowledge_base(spark, sf)["tables"])


@register("register_views", "SELECT p_brand, count(*) AS n, max(p_size) AS largest FROM part GROUP BY p_brand")
def register_views(spark, sf):
    """A stored all-text table, seen under its name with its own columns."""
    kb = I.knowledge_base(spark, sf)
    S.register_views({f"kb_{name}": kb[name] for name in ("tables", "sheets", "columns")}, kb["rows"], ["star_part"])
    return S.select(spark, "SELECT p_brand, count(*) AS n, max(cast(p_size AS int)) AS largest FROM star_part GROUP BY p_brand", None)


@register("default_query", sql("SELECT table_name, source, page, label AS sheet FROM star_tabs", "star_tabs"))
def default_query(spark, sf):
    kb = I.knowledge_base(spark, sf)
    S.register_views({f"kb_{name}": kb[name] for name in ("tables", "sheets", "columns")})
    return S.select(spark, S.DEFAULT_QUERY)


@register("select_capped", "SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 1000)")
def select_capped(spark, sf):
    """The console's cap of 1000 rows."""
    _views(spark, sf)
    return S.select(spark, "SELECT o_orderkey FROM orders;  ").selectExpr("count(*) AS n")


def shape(name: str, text: str, oracle: str | None = None) -> None:
    """A SELECT over the star tables; the same text in both engines unless ``oracle`` differs."""

    @register(f"select_{name}", oracle or text)
    def run(spark, sf):
        _views(spark, sf)
        return S.select(spark, text, None)


shape("filters", """SELECT c_custkey, c_name, c_mktsegment FROM customer
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 0 AND 5000 AND c_name LIKE 'Customer#%1_' AND c_name ILIKE '%CUSTOMER%' AND c_nationkey IS NOT NULL""")
shape("star_join", """SELECT r_name, n_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY r_name, n_name""")
shape("outer_joins", """SELECT 'left' AS how, count(*) AS n, count(o_orderkey) AS right_side FROM customer LEFT JOIN orders ON c_custkey = o_custkey
    UNION ALL SELECT 'right', count(*), count(c_custkey) FROM customer RIGHT JOIN orders ON c_custkey = o_custkey AND c_acctbal > 0
    UNION ALL SELECT 'full', count(*), count(s_suppkey) FROM customer FULL JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey""")
shape("semi_anti", """SELECT c_custkey, 'has' AS kind FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)
    UNION ALL SELECT c_custkey, 'none' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
# What follows within an hour is the rest of the own slot and the beginning of the next one, so that no pair of events is listed.
shape("range_join", """WITH marked AS (SELECT event_id, event_id AS seen, true AS own, ts, date_trunc('HOUR', ts) AS slot FROM events WHERE ts IS NOT NULL
    UNION ALL SELECT event_id, NULL, false, ts + INTERVAL 1 HOUR, date_trunc('HOUR', ts + INTERVAL 1 HOUR) FROM events WHERE ts IS NOT NULL),
    counted AS (SELECT event_id, CASE WHEN own THEN count(CASE WHEN own THEN 1 END) OVER later ELSE count(CASE WHEN own THEN 1 END) OVER upto END AS n, CASE WHEN own THEN max(seen) OVER later ELSE max(seen) OVER upto END AS last
    FROM marked WINDOW later AS (PARTITION BY slot ORDER BY ts DESC RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '0.000001' SECOND PRECEDING), upto AS (PARTITION BY slot ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT event_id, sum(n) AS n, max(last) AS last_id FROM counted GROUP BY event_id HAVING sum(n) > 0""",
      "SELECT e.event_id, count(*) AS n, max(b.event_id) AS last_id FROM events e JOIN events b ON b.ts > e.ts AND b.ts <= e.ts + INTERVAL 1 HOUR GROUP BY e.event_id")
# Within a day by a window, over days by the last view of each earlier day, so that no task holds all events of a user.
shape("as_of_join", """WITH marked AS (SELECT event_id, user_id, event_type, ts, date_trunc('DAY', ts) AS day, CASE WHEN event_type = 'view' THEN event_id END AS viewed FROM events),
    inside AS (SELECT *, last_value(viewed) IGNORE NULLS OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS same_day FROM marked),
    days AS (SELECT user_id, day, max_by(viewed, struct(ts, event_id)) FILTER (WHERE viewed IS NOT NULL) AS viewed FROM marked GROUP BY user_id, day),
    earlier AS (SELECT user_id, day, last_value(viewed) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM days)
    SELECT event_id, coalesce(same_day, before) AS last_view FROM inside JOIN earlier USING (user_id, day) WHERE event_type = 'purchase'""",
      """SELECT p.event_id, v.event_id AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")  # fmt: skip
shape("aggregates", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 4) AS price,
    count(*) FILTER (WHERE l_discount > 0.05) AS discounted FROM lineitem GROUP BY ALL HAVING count(*) > 10""")
shape("quantiles", """SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, round(percentile(o_totalprice, 0.5), 4) AS median, round(percentile(o_totalprice, array(0.25))[0], 4) AS quarter
    FROM orders GROUP BY o_orderstatus""",
      """SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.25), 4) AS quarter
    FROM orders GROUP BY o_orderstatus""")  # fmt: skip
# Beside a distinct count the other aggregates would be kept for every customer before they are put together.
shape("approximate", """WITH others AS (SELECT percentile(o_totalprice, 0.5) AS middle, approx_count_distinct(o_custkey, 0.01) AS about, percentile_approx(o_totalprice, 0.5, 100000) AS near FROM orders),
    both AS (SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS customers, middle, about, near FROM others)
    SELECT customers, round(middle, 4) AS median, abs(about / customers - 1) < 0.1 AS distinct_close, abs(near / middle - 1) < 0.02 AS median_close FROM both""",
      """SELECT count(DISTINCT o_custkey) AS customers, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
    abs(approx_count_distinct(o_custkey) / count(DISTINCT o_custkey) - 1) < 0.1 AS distinct_close,
    abs(approx_quantile(o_totalprice, 0.5) / quantile_cont(o_totalprice, 0.5) - 1) < 0.02 AS median_close FROM orders""")  # fmt: skip
shape("grouping_sets", """SELECT c_mktsegment, c_nationkey, grouping_id(c_mktsegment, c_nationkey) AS level, count(*) AS n FROM customer GROUP BY CUBE(c_mktsegment, c_nationkey)""")
shape("rollup", """SELECT p_brand, p_type, count(*) AS n, 'rollup' AS kind FROM part GROUP BY ROLLUP(p_brand, p_type)
    UNION ALL SELECT p_brand, p_type, count(*), 'sets' FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())""")
shape("ranking", """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, ntile(4) OVER w AS nt, round(percent_rank() OVER v, 6) AS pr
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
shape("analytic", """SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after2, first_value(event_id) OVER w AS first_id,
    last_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id, nth_value(event_id, 2) OVER w AS second_id
    FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""")
shape("frames", """SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving,
    count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW) AS in_month,
    round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running FROM orders""")
shape("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
shape("top_k_per_group", """SELECT c_nationkey, o_orderkey, o_totalprice FROM (SELECT c_nationkey, o_orderkey, o_totalprice,
    row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey) x WHERE n <= 3""")
shape("set_operations", """(SELECT c_nationkey AS k, 'union' AS op FROM customer UNION SELECT s_nationkey, 'union' FROM supplier)
    UNION ALL (SELECT c_nationkey, 'intersect' FROM customer INTERSECT SELECT s_nationkey, 'intersect' FROM supplier)
    UNION ALL (SELECT n_nationkey, 'except' FROM nation EXCEPT SELECT s_nationkey, 'except' FROM supplier)
    UNION ALL (SELECT c_nationkey, 'intersect all' FROM customer INTERSECT ALL SELECT s_nationkey, 'intersect all' FROM supplier)
    UNION ALL (SELECT s_nationkey, 'except all' FROM supplier EXCEPT ALL SELECT n_nationkey, 'except all' FROM nation)""")
shape("subqueries", """WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
    SELECT c_custkey, round(total, 2) AS total, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AS closed
    FROM customer c JOIN big ON o_custkey = c_custkey WHERE total > (SELECT avg(total) FROM big)""")
shape("functions", """SELECT e.event_id, upper(e.event_type) AS kind, length(e.props) AS n, cast(get_json_object(e.props, '$.k') AS int) AS k, date_format(e.ts, 'yyyy-MM-dd') AS day, hour(e.ts) AS h,
    abs(round(e.value)) AS v, substr(e.event_type, 2, 3) AS part, array_join(transform(sequence(1, 3), x -> x * hour(e.ts)), '-') AS xs, map('a', e.user_id)['a'] AS m,
    concat_ws('/', e.event_type, cast(e.user_id AS string)) AS path, coalesce(nullif(e.event_type, 'view'), 'seen') AS c FROM events e""",
      """SELECT e.event_id, upper(e.event_type) AS kind, length(e.props) AS n, json_extract_string(e.props, '$.k')::INT AS k, strftime(e.ts, '%Y-%m-%d') AS day, hour(e.ts) AS h,
    abs(round(e.value)) AS v, substr(e.event_type, 2, 3) AS part, array_to_string(list_transform([1, 2, 3], lambda x: x * hour(e.ts)), '-') AS xs, e.user_id AS m,
    concat_ws('/', e.event_type, e.user_id::VARCHAR) AS path, coalesce(nullif(e.event_type, 'view'), 'seen') AS c FROM events e""")  # fmt: skip
shape("pivot", """SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (count(l_quantity) FOR l_linestatus IN ('F' AS closed, 'O' AS open))""",
      "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS closed, count(*) FILTER (l_linestatus = 'O') AS open FROM lineitem GROUP BY l_returnflag")
shape("unpivot", """SELECT p_partkey, attribute, content FROM (SELECT p_partkey, p_name, p_brand, p_type FROM part) UNPIVOT (content FOR attribute IN (p_name, p_brand, p_type))""",
      """SELECT p_partkey, unnest(['p_name', 'p_brand', 'p_type']) AS attribute, unnest([p_name, p_brand, p_type]) AS content FROM part""")  # fmt: skip
