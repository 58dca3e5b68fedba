"""SQL building blocks: the adapter and the scoring chain as common table expressions for DuckDB."""

from __future__ import annotations

from veldt.plans.catalogue import CATALOGUE, as_values

_CANDIDATES = as_values([(i, d, way, k, m, g) for i, d, way, found in CATALOGUE for k, (m, g) in enumerate(found)])

COMPANIES = """
companies AS (
  SELECT 'star-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS company_id, s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS stock_code,
    s_name AS short_name, n_name AS peer_group_id, r_name AS benchmark_group, s_acctbal AS acctbal, n_nationkey
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

EVENTS = """
risk_events AS (
  SELECT event_id, 'star-' || lpad(CAST(user_id % (SELECT count(*) FROM supplier) AS VARCHAR), 6, '0') AS company_id,
    user_id % (SELECT count(*) FROM supplier) AS s_suppkey,
    CASE event_type WHEN 'error' THEN 'screening' WHEN 'signup' THEN 'inquiry' WHEN 'purchase' THEN 'deep-search' ELSE 'litigation' END AS kind,
    strftime(ts, '%Y-%m-%d') AS event_date, event_type || ' user ' || user_id AS title, value
  FROM events WHERE event_type IN ('error', 'signup', 'purchase', 'view'))"""

OBSERVATIONS = f"""{COMPANIES}, {EVENTS},
line AS (
  SELECT l_suppkey AS s_suppkey, l_orderkey, l_partkey, year(l_shipdate) AS y, month(l_shipdate) AS m, CAST(l_shipdate AS DATE) AS d,
    CAST(trunc(l_quantity) AS BIGINT) AS q, l_returnflag, l_linestatus, l_linenumber FROM lineitem),
yearly AS (
  SELECT s_suppkey, y, max(d) AS last, count(DISTINCT l_partkey) AS parts, count(*) AS n, count(*) FILTER (p_type LIKE 'PROMO%') AS promo,
    count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS open_lines, CAST(sum(q) AS BIGINT) AS quantity,
    count(DISTINCT l_orderkey) AS orders, count(DISTINCT p_brand) AS brands, count(DISTINCT m) AS months, count(*) FILTER (m = 12) AS december,
    count(*) FILTER (l_linenumber = 1) AS first_lines
  FROM line JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
with_before AS (SELECT a.*, b.quantity AS before FROM yearly a LEFT JOIN yearly b ON a.s_suppkey = b.s_suppkey AND a.y = b.y + 1),
sold AS (
  SELECT s_suppkey, y, o_custkey, sum(q) AS q, count(*) AS n, max(d) AS last FROM line JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
shares AS (
  SELECT sold.s_suppkey, y, max(last) AS last, CAST(sum(CASE WHEN h.n_regionkey <> a.n_regionkey THEN n ELSE 0 END) AS BIGINT) AS abroad,
    CAST(sum(n) AS BIGINT) AS n, CAST(max(q) AS BIGINT) AS most, CAST(sum(q) AS BIGINT) AS quantity
  FROM sold JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey
    JOIN supplier s ON sold.s_suppkey = s.s_suppkey JOIN nation h ON s_nationkey = h.n_nationkey GROUP BY 1, 2),
counted AS (
  SELECT s_suppkey, substr(event_date, 1, 4) AS y, max(event_date) AS last, count(*) FILTER (kind = 'screening') AS errors,
    count(*) FILTER (kind = 'inquiry') AS signups FROM risk_events GROUP BY 1, 2),
long_form AS (
  SELECT s_suppkey, strftime(last, '%Y-%m-%d') AS as_of_date, u.* FROM with_before, LATERAL (VALUES
    ('R05', 'cnipa_core_operating_entity_valid_count', CASE WHEN s_suppkey % 5 <> 0 THEN CAST(parts AS DOUBLE) END),
    ('R05', 'tyc_paid_patent_total_asof', CAST(n AS DOUBLE)),
    ('R06', 'rd_personnel_ratio_pct', CAST(100 AS DOUBLE) * promo / n),
    ('R08', 'fundraising_project_delay_event_count', CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 7 <> 0 THEN CAST(returned AS DOUBLE) END),
    ('R08', 'rd_negative_milestone_event_count', CASE WHEN s_suppkey % 7 <> 0 THEN CAST(open_lines AS DOUBLE) END),
    ('R13', 'revenue_growth_pct', CAST(100 AS DOUBLE) * (quantity - before) / nullif(before, 0)),
    ('R16', 'ocf_short_debt_coverage', CAST(quantity AS DOUBLE) / orders),
    ('R17', 'tyc_paid_supplier_domestic_profile_count', CAST(brands AS DOUBLE)),
    ('R19', 'us_csl_distinct_list_hit_count', CAST(december AS DOUBLE)),
    ('R19', 'eu_fsd_exact_name_hit_count', CASE WHEN s_suppkey % 2 = 0 THEN CAST(first_lines AS DOUBLE) END),
    ('R22', 'core_tech_departure_event_count', CAST(12 - months AS DOUBLE))) u(indicator_id, metric_name, numeric_value)
  UNION ALL
  SELECT s_suppkey, strftime(last, '%Y-%m-%d'), u.* FROM shares, LATERAL (VALUES
    ('R18', 'overseas_revenue_ratio_pct', CAST(100 AS DOUBLE) * abroad / n),
    ('R20', 'maximum_controller_ratio_pct', CAST(100 AS DOUBLE) * most / nullif(quantity, 0))) u(indicator_id, metric_name, numeric_value)
  UNION ALL
  SELECT s_suppkey, last, u.* FROM counted, LATERAL (VALUES
    ('R10', 'tyc_paid_admin_penalty_total_asof', CAST(errors AS DOUBLE)),
    ('R11', 'exchange_inquiry_topic_count', CAST(signups AS DOUBLE))) u(indicator_id, metric_name, numeric_value)),
observations AS (
  SELECT 'observation:' || s_suppkey || ':' || metric_name || ':' || as_of_date AS observation_id,
    'star-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS company_id, indicator_id, metric_name, as_of_date, numeric_value
  FROM long_form WHERE numeric_value IS NOT NULL)"""

SCORES = f"""{OBSERVATIONS},
candidates(indicator_id, dimension_id, direction, rank, metric_name, comparable_group) AS (VALUES {_CANDIDATES}),
newest AS (
  SELECT company_id, metric_name, as_of_date, observation_id, numeric_value FROM (
    SELECT *, row_number() OVER (PARTITION BY company_id, metric_name ORDER BY as_of_date DESC, observation_id DESC) AS k FROM observations) WHERE k = 1),
with_composite AS (
  SELECT company_id, metric_name, numeric_value FROM newest
  UNION ALL SELECT company_id, 'export_control_list_hits', sum(numeric_value) FROM newest
  WHERE metric_name IN ('us_csl_distinct_list_hit_count', 'eu_fsd_exact_name_hit_count') GROUP BY 1),
resolved AS (
  SELECT * FROM (
    SELECT company_id, c.*, numeric_value, row_number() OVER (PARTITION BY company_id, indicator_id ORDER BY rank) AS k
    FROM with_composite JOIN candidates c USING (metric_name)) WHERE k = 1),
risk AS (
  SELECT r.*, benchmark_group, CASE WHEN direction = 'down' THEN -numeric_value ELSE numeric_value END AS risk_value
  FROM resolved r JOIN companies USING (company_id)),
ranked AS (
  SELECT *, count(*) OVER g AS sample_size, rank() OVER (PARTITION BY benchmark_group, indicator_id, comparable_group ORDER BY risk_value) - 1 AS below,
    count(*) OVER (PARTITION BY benchmark_group, indicator_id, comparable_group, risk_value) AS ties
  FROM risk WINDOW g AS (PARTITION BY benchmark_group, indicator_id, comparable_group)),
percentiles AS (
  SELECT *, CASE WHEN sample_size > 1 THEN floor((below + (ties - 1) / CAST(2 AS DOUBLE)) / (sample_size - 1) * CAST(10000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(10000 AS DOUBLE) END AS risk_percentile FROM ranked),
scores AS (
  SELECT *, CASE WHEN risk_percentile IS NOT NULL THEN floor(CAST(100 AS DOUBLE) * least(greatest(CAST(0.5 AS DOUBLE) * CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * risk_percentile, 0), 1) * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(100 AS DOUBLE) END AS risk_score
  FROM percentiles)"""


def half_up(x: str, digits: int) -> str:
    d = f"CAST({10**digits} AS DOUBLE)"
    return f"floor(({x}) * {d} + CAST(0.5 AS DOUBLE)) / {d}"


def weights(prefix: str, matrix: str, method: str) -> str:
    """CTEs that end in <prefix>_weights(benchmark_group, column_name, weight), from rows (benchmark_group, company_id, column_name, x)."""
    p = prefix
    head = f"""
{p}_m AS ({matrix}),
{p}_active AS (SELECT benchmark_group, column_name, count(x) AS n, stddev_pop(x) AS std FROM {p}_m WHERE x IS NOT NULL GROUP BY 1, 2 HAVING count(x) >= 2),"""
    if method == "critic":
        info = f"""
{p}_pairs AS (SELECT a.benchmark_group, a.column_name AS a, b.column_name AS b, a.x AS x, b.x AS y,
    avg(a.x) OVER w AS mx, avg(b.x) OVER w AS my FROM {p}_m a JOIN {p}_m b ON a.benchmark_group = b.benchmark_group AND a.company_id = b.company_id AND a.column_name <> b.column_name
    WHERE a.x IS NOT NULL AND b.x IS NOT NULL WINDOW w AS (PARTITION BY a.benchmark_group, a.column_name, b.column_name)),
{p}_sums AS (SELECT benchmark_group, a, b, count(*) AS n, sum((x - mx) * (y - my)) AS sxy, sum((x - mx) * (x - mx)) AS sxx, sum((y - my) * (y - my)) AS syy FROM {p}_pairs GROUP BY 1, 2, 3),
{p}_rho AS (SELECT benchmark_group, a, b, CASE WHEN n < 2 OR sxx * syy = 0 THEN 0 ELSE sxy / sqrt(sxx * syy) END AS rho FROM {p}_sums),
{p}_conflict AS (SELECT a.benchmark_group, a.column_name, sum(CASE WHEN b.column_name IS NULL THEN 0 ELSE 1 - abs(coalesce(rho, 0)) END) AS conflict
    FROM {p}_active a LEFT JOIN {p}_active b ON a.benchmark_group = b.benchmark_group AND a.column_name <> b.column_name
    LEFT JOIN {p}_rho r ON r.benchmark_group = a.benchmark_group AND r.a = a.column_name AND r.b = b.column_name GROUP BY 1, 2),
{p}_info AS (SELECT benchmark_group, column_name, std * conflict AS information FROM {p}_active JOIN {p}_conflict USING (benchmark_group, column_name)),"""
    else:
        info = f"""
{p}_v AS (SELECT benchmark_group, column_name, greatest(x, 0) + CAST(1e-12 AS DOUBLE) AS v FROM {p}_m WHERE x IS NOT NULL),
{p}_p AS (SELECT benchmark_group, column_name, v / sum(v) OVER (PARTITION BY benchmark_group, column_name) AS p FROM {p}_v),
{p}_info AS (SELECT benchmark_group, column_name, greatest(0, 1 + sum(p * ln(p)) / ln(max(n))) AS information FROM {p}_p JOIN {p}_active USING (benchmark_group, column_name) GROUP BY 1, 2),"""
    tail = f"""
{p}_weights AS (SELECT benchmark_group, column_name, {half_up(f"CASE WHEN sum(information) OVER g > 0 THEN information / sum(information) OVER g ELSE CAST(1 AS DOUBLE) / count(*) OVER g END", 6)} AS weight
    FROM {p}_info WINDOW g AS (PARTITION BY benchmark_group))"""
    return head + info + tail


def totals(method: str) -> str:
    """The chain up to total scores: CTEs first_weights, dims, second_weights, joined, total."""
    mean = "coalesce(sum(CASE WHEN w > 0 THEN w * s END) / nullif(sum(CASE WHEN w > 0 THEN w END), 0), avg(s))"
    first = weights("first", "SELECT benchmark_group, company_id, indicator_id AS column_name, risk_score / CAST(100 AS DOUBLE) AS x FROM scores WHERE dimension_id <> 'narrative'", method)
    second = weights("second", "SELECT benchmark_group, company_id, dimension_id AS column_name, dimension_score / CAST(100 AS DOUBLE) AS x FROM dims", method)
    return f"""{SCORES}, {first},
dims AS (SELECT company_id, benchmark_group, dimension_id, {half_up(mean, 2)} AS dimension_score FROM (
    SELECT sc.company_id, sc.benchmark_group, sc.dimension_id, sc.risk_score AS s, coalesce(w.weight, 0) AS w
    FROM scores sc LEFT JOIN first_weights w ON w.benchmark_group = sc.benchmark_group AND w.column_name = sc.indicator_id
    WHERE sc.dimension_id <> 'narrative' AND sc.risk_score IS NOT NULL) GROUP BY 1, 2, 3), {second},
total AS (SELECT company_id, benchmark_group, {half_up(mean, 2)} AS total_score, count(s) AS dimensions_scored FROM (
    SELECT d.company_id, d.benchmark_group, d.dimension_score AS s, coalesce(w.weight, 0) AS w
    FROM dims d LEFT JOIN second_weights w ON w.benchmark_group = d.benchmark_group AND w.column_name = d.dimension_id) GROUP BY 1, 2)"""
