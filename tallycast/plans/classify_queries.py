"""Classification, clustering and sampling (G, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycast.config import CLUSTER, ClusterConfig
from tallycast.operators import anomaly, classify, conform, forecast, sampling
from tallycast.plans.data import Register, demand, demand_sql

R = Register()
PART = "WITH " + demand_sql("part")
TOTALS = f"{PART}, totals AS (SELECT sku, sum(quantity) AS total_volume FROM demand GROUP BY sku)"
ABC_SQL = f"""{TOTALS}, c AS (SELECT *, sum(total_volume) OVER (ORDER BY total_volume DESC, md5(sku) ROWS UNBOUNDED PRECEDING)
    / (SELECT sum(total_volume) FROM totals) * 100 AS cumulative_pct FROM totals), abc AS (
    SELECT *, CASE WHEN cumulative_pct <= 80 THEN 'A' WHEN cumulative_pct <= {{b}} THEN 'B' ELSE 'C' END AS abc_class FROM c)"""
R.add("g1_abc_classes", "sku, total_volume:d, cumulative_pct:d, abc_class", f"{ABC_SQL.format(b=130)} SELECT * FROM abc",
      lambda s, d: classify.abc_classes(demand(s, d)))
R.add("g1_abc_usual_limits", "sku, abc_class", f"{ABC_SQL.format(b=95)} SELECT * FROM abc",
      lambda s, d: classify.abc_classes(demand(s, d), b_limit=95))
R.add("g2_abc_summary", "abc_class, items:i, pct_of_items:d", f"""{ABC_SQL.format(b=130)}
    SELECT k AS abc_class, count(sku) AS items, 100.0 * count(sku) / (SELECT count(*) FROM abc) AS pct_of_items
    FROM (VALUES ('A'), ('B'), ('C')) v(k) LEFT JOIN abc ON abc_class = k GROUP BY k""",
      lambda s, d: classify.abc_summary(classify.abc_classes(demand(s, d))))


def cluster_sql(by: str = "part", config: ClusterConfig = CLUSTER, name: str = "demand") -> str:
    """CTE list ending in ``clusters``, for the demand view of that grain."""
    if config.fixed_volumes:
        limits = f"SELECT {config.fixed_volumes[0]} AS a_threshold, {config.fixed_volumes[1]} AS b_threshold"
    else:
        a, b = config.top_percentiles
        limits = f"""SELECT max(total_volume) FILTER (r = least(CAST(floor(n * {100 - a} / 100) AS BIGINT), n - 1)) AS a_threshold,
            max(total_volume) FILTER (r = least(CAST(floor(n * {100 - b} / 100) AS BIGINT), n - 1)) AS b_threshold
            FROM (SELECT total_volume, row_number() OVER (ORDER BY total_volume DESC) - 1 AS r, count(*) OVER () AS n FROM metrics)"""
    return f"""{demand_sql(by)}, metrics AS (
        SELECT sku, coalesce(sum(quantity), 0) AS total_volume, avg(quantity) AS mean_volume, stddev_samp(quantity) AS std_volume,
            count(*) AS data_points, CASE WHEN avg(quantity) > 0 THEN stddev_samp(quantity) / avg(quantity) ELSE 0 END AS cv,
            CASE WHEN sum(quantity) > 0 THEN coalesce(sum(quantity) FILTER (month(date) >= 10), 0) / sum(quantity) ELSE 0 END AS q4_concentration
        FROM demand GROUP BY sku), limits AS ({limits}), typed AS (
        SELECT m.*, a_threshold, b_threshold, CASE WHEN total_volume >= a_threshold THEN 'A' WHEN total_volume >= b_threshold THEN 'B' ELSE 'C' END AS volume_tier,
            CASE WHEN q4_concentration >= {config.seasonal} THEN 'seasonal' WHEN cv >= {config.erratic} THEN 'erratic'
                 WHEN cv >= {config.variable} THEN 'variable' ELSE 'steady' END AS pattern_type FROM metrics m, limits), clusters AS (
        SELECT *, CASE volume_tier WHEN 'A' THEN 'High Volume' WHEN 'B' THEN 'Medium Volume' ELSE 'Low Volume' END || ' - '
            || upper(pattern_type[1]) || pattern_type[2:] AS cluster FROM typed)"""


CLUSTERS = "WITH " + cluster_sql()
CLUSTER_ROW = "sku, volume_tier, pattern_type, cluster, total_volume:d, cv:d, q4_concentration:d"


def _clusters(spark, folder, config=CLUSTER):
    return classify.cluster_items(demand(spark, folder), config)


R.add("g3_item_metrics", "sku, total_volume:d, mean_volume:d, std_volume:d, cv:d, q4_concentration:d, data_points:i",
      f"{CLUSTERS} SELECT * FROM metrics", lambda s, d: classify.item_metrics(demand(s, d)))
R.add("g4_volume_thresholds", "a_threshold:d, b_threshold:d", f"{CLUSTERS} SELECT * FROM limits",
      lambda s, d: classify.volume_thresholds(classify.item_metrics(demand(s, d))))
FIXED = CLUSTER.with_volumes()
R.add("g5_fixed_tiers", "sku, volume_tier", f"WITH {cluster_sql(config=FIXED)} SELECT * FROM clusters", lambda s, d: _clusters(s, d, FIXED))
R.add("g6_patterns", "sku, pattern_type", f"{CLUSTERS} SELECT * FROM clusters", _clusters)
R.add("g7_clusters", CLUSTER_ROW, f"{CLUSTERS} SELECT * FROM clusters", _clusters)
SUMMARY_SQL = f"""{CLUSTERS} SELECT cluster, volume_tier, pattern_type, count(*) AS item_count, sum(total_volume) AS total_volume,
    count(*) * 100.0 / sum(count(*)) OVER () AS pct_of_items, sum(total_volume) * 100.0 / sum(sum(total_volume)) OVER () AS pct_of_volume
    FROM clusters GROUP BY ALL"""
SUMMARY_ROW = "cluster, volume_tier, pattern_type, item_count:i, total_volume:d, pct_of_items:d, pct_of_volume:d"
R.add("g8_cluster_summary", SUMMARY_ROW, SUMMARY_SQL, lambda s, d: classify.cluster_summary(_clusters(s, d)))
MATRIX_SQL = f"""{CLUSTERS}, matrix AS (SELECT t AS volume_tier, {', '.join(f"count(*) FILTER (pattern_type = '{p}') AS {p}" for p in ('seasonal', 'erratic', 'variable', 'steady'))}
    FROM (VALUES ('A'), ('B'), ('C')) v(t) LEFT JOIN clusters ON volume_tier = t GROUP BY t)"""
R.add("g9_cluster_matrix", "volume_tier, seasonal:i, erratic:i, variable:i, steady:i", f"{MATRIX_SQL} SELECT * FROM matrix",
      lambda s, d: classify.cluster_matrix(_clusters(s, d)))
R.add("g10_matrix_summary", "total_items:i, largest_tier, largest_pattern, largest_items:i", f"""{MATRIX_SQL}, cells AS (
    SELECT volume_tier, pattern_type, items FROM (UNPIVOT matrix ON seasonal, erratic, variable, steady INTO NAME pattern_type VALUE items))
    SELECT (SELECT sum(items) FROM cells) AS total_items, volume_tier AS largest_tier, pattern_type AS largest_pattern, items AS largest_items
    FROM cells ORDER BY items DESC, volume_tier, list_position(['seasonal', 'erratic', 'variable', 'steady'], pattern_type) LIMIT 1""",
      lambda s, d: classify.matrix_summary(classify.cluster_matrix(_clusters(s, d))))
R.add("g11_select_clusters", CLUSTER_ROW, f"{CLUSTERS} SELECT * FROM clusters WHERE volume_tier = 'A' AND pattern_type = 'variable'",
      lambda s, d: classify.select_clusters(_clusters(s, d), "A", "variable"))
CUSTOM = ClusterConfig(top_percentiles=(90.0, 70.0), seasonal=0.4, erratic=0.6, variable=0.5)
R.add("g12_custom_thresholds", CLUSTER_ROW, f"WITH {cluster_sql(config=CUSTOM)} SELECT * FROM clusters", lambda s, d: _clusters(s, d, CUSTOM))
R.add("g13_navigator_cluster", "group_name, items:i", f"{CLUSTERS} SELECT cluster AS group_name, count(*) AS items FROM clusters WHERE contains(sku, '1') GROUP BY cluster",
      lambda s, d: classify.navigator(_clusters(s, d), "cluster", "1"))
R.add("g13_navigator_category", "group_name, sku", f"""WITH {demand_sql('part', category=True)}
    SELECT min(category) AS group_name, sku FROM demand WHERE contains(sku, '1') GROUP BY sku""",
      lambda s, d: classify.navigator_items(conform.items(demand(s, d, category=True)), "category", "1"))

IQR_COUNT_SQL = """fence AS (SELECT sku, quantile_cont(quantity, 0.25) AS q1, quantile_cont(quantity, 0.75) AS q3 FROM demand GROUP BY sku HAVING count(quantity) >= 4),
    hits AS (SELECT d.sku, count(*) AS anomaly_count FROM demand d JOIN fence USING (sku)
        WHERE quantity < q1 - 1.5 * (q3 - q1) OR quantity > q3 + 1.5 * (q3 - q1) GROUP BY d.sku)"""


def _details(spark, folder):
    df = demand(spark, folder)
    results = forecast.forecast(df, ["naive"], 28, "W")
    return classify.item_details(classify.cluster_items(df), results, anomaly.detect_iqr(df))


R.add("g14_item_details", "sku, cluster, total_volume:d, mape:d, anomaly_count:i", f"""{CLUSTERS}, {IQR_COUNT_SQL},
    weeks AS (SELECT sku, CAST(date_trunc('week', date) AS DATE) AS p, sum(quantity) AS y FROM demand GROUP BY ALL),
    span AS (SELECT sku, (datediff('day', min(p), max(p)) / 7) + 1 AS n, sum(y) / ((datediff('day', min(p), max(p)) / 7) + 1) AS m FROM weeks GROUP BY sku),
    err AS (SELECT sku, coalesce(avg(abs((y - m) / y)) FILTER (y <> 0) * 100, 0) AS mape FROM weeks JOIN span USING (sku) GROUP BY sku)
    SELECT c.*, mape, coalesce(anomaly_count, 0) AS anomaly_count FROM clusters c LEFT JOIN err USING (sku) LEFT JOIN hits USING (sku)""", _details)

# --- sampling ---------------------------------------------------------------------------
DRAW = "md5('42:' || sku)"
R.add("b1_random_items", "sku", f"{PART} SELECT DISTINCT sku FROM demand ORDER BY {DRAW} LIMIT 50",
      lambda s, d: sampling.random_items(demand(s, d).select("sku").distinct(), 50))
R.add("b2_stratified_items", "sku, volume_tier", f"""{CLUSTERS}, placed AS (
    SELECT sku, volume_tier, row_number() OVER (PARTITION BY volume_tier ORDER BY {DRAW}, sku) AS place FROM clusters)
    SELECT sku, volume_tier FROM placed WHERE place <= 20 // 3 ORDER BY volume_tier, place LIMIT 20""",
      lambda s, d: sampling.stratified_items(_clusters(s, d), "volume_tier", 20))
R.add("b3_representative_items", "sku", f"""{TOTALS}, q AS (SELECT quantile_cont(total_volume, [0, 0.25, 0.5, 0.75, 1]) AS v FROM totals),
    bands AS (SELECT sku, b FROM totals, q, range(1, 5) r(b) WHERE total_volume >= v[b] AND total_volume <= v[b + 1]),
    placed AS (SELECT sku, row_number() OVER (PARTITION BY b ORDER BY {DRAW}, sku) AS place FROM bands)
    SELECT DISTINCT sku FROM placed WHERE place <= 5 ORDER BY sku LIMIT 20""",
      lambda s, d: sampling.representative_items(classify.item_totals(demand(s, d)), 20))
SUPP = "WITH " + demand_sql("supp")
TREND_SQL = f"""{SUPP}, placed AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY date, row_id) - 1 AS x, count(*) OVER (PARTITION BY sku) AS n FROM demand),
    trend AS (SELECT sku, coalesce(avg(quantity) FILTER (x >= n // 2) - avg(quantity) FILTER (x < n // 2), 0) AS measure FROM placed GROUP BY sku)"""
R.add("b4_sparkline_order", "sku, measure:d", f"{TREND_SQL} SELECT * FROM trend ORDER BY round(measure, 9) DESC, sku LIMIT 20",
      lambda s, d: sampling.sparkline_order(demand(s, d, "supp"), "trend"))
R.add("b4_sparkline_rows", "sku, position:i, date, y:d", f"""{SUPP}, top AS (SELECT sku FROM demand GROUP BY sku ORDER BY sum(quantity) DESC, sku LIMIT 20)
    SELECT sku, row_number() OVER (PARTITION BY sku ORDER BY date, row_id) - 1 AS position, date, quantity AS y FROM demand WHERE sku IN (SELECT sku FROM top)""",
      lambda s, d: sampling.sparkline_rows(demand(s, d, "supp"), "volume_high"))
