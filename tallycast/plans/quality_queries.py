"""Quality metrics and cleaning (Q, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycast.operators import clean, quality
from tallycast.plans.data import DIRTY, Register, demand, demand_sql, dirty, events, events_sql

R = Register()
DIRTY_PART = "WITH " + demand_sql("part", quantity=DIRTY)
DIRTY_SUPP = "WITH " + demand_sql("supp", quantity=DIRTY)
PART = "WITH " + demand_sql("part", category=True)
SUPP = "WITH " + demand_sql("supp")
COLUMNS = ("date", "sku", "quantity", "price", "promo")
ROW = "sku, date, quantity:d, row_id:i"

METRICS_SQL = f"""{DIRTY_PART}, dup AS (SELECT sku, date, count(*) AS n FROM demand GROUP BY sku, date), m AS (
    SELECT count(*) AS rows, count(DISTINCT sku) AS items,
        sum({' + '.join(f'CAST({c} IS NULL AS INT)' for c in COLUMNS)}) AS missing_cells,
        (SELECT sum(n - 1) FROM dup) AS duplicates, count(*) FILTER (quantity < 0) AS negatives,
        datediff('day', min(date), max(date)) AS date_range_days FROM demand), metrics AS (
    SELECT *, missing_cells / (rows * {len(COLUMNS)}) * 100 AS missing_pct, duplicates / rows * 100 AS duplicate_pct,
        negatives / rows * 100 AS negative_pct, rows / items AS avg_points_per_item FROM m)"""


def _metrics(spark, folder):
    return quality.quality_metrics(dirty(spark, folder), COLUMNS)


R.add("q1_missing", "missing_cells:i, missing_pct:d, status", f"""{METRICS_SQL} SELECT *,
    CASE WHEN missing_pct < 5 THEN 'good' WHEN missing_pct < 15 THEN 'warning' ELSE 'critical' END AS status FROM metrics""",
      lambda s, d: quality.quality_report(dirty(s, d), COLUMNS).withColumnRenamed("missing_status", "status"))
R.add("q2_duplicates", "duplicates:i, duplicate_pct:d", f"{METRICS_SQL} SELECT * FROM metrics", _metrics)
R.add("q3_negatives", "negatives:i, negative_pct:d", f"{METRICS_SQL} SELECT * FROM metrics", _metrics)
R.add("q4_coverage", "date_range_days:i, avg_points_per_item:d", f"{METRICS_SQL} SELECT * FROM metrics", _metrics)
R.add("q5_quality_report", "overall_score:d, missing_status, duplicate_status, negative_status, coverage_status, issue_text", f"""{METRICS_SQL}
    SELECT greatest(0, least(100, 100 - (CASE WHEN missing_pct > 5 THEN least(20, missing_pct) ELSE 0 END
        + CASE WHEN duplicates > 0 THEN least(15, duplicate_pct * 2) ELSE 0 END
        + CASE WHEN negatives > 0 THEN least(10, negative_pct * 3) ELSE 0 END
        + CASE WHEN avg_points_per_item < 7 THEN 10 ELSE 0 END))) AS overall_score,
        CASE WHEN missing_pct < 5 THEN 'good' WHEN missing_pct < 15 THEN 'warning' ELSE 'critical' END AS missing_status,
        CASE WHEN duplicate_pct = 0 THEN 'good' WHEN duplicate_pct < 5 THEN 'warning' ELSE 'critical' END AS duplicate_status,
        CASE WHEN negative_pct = 0 THEN 'good' WHEN negative_pct < 2 THEN 'warning' ELSE 'critical' END AS negative_status,
        CASE WHEN avg_points_per_item >= 12 THEN 'good' WHEN avg_points_per_item >= 7 THEN 'warning' ELSE 'critical' END AS coverage_status,
        concat_ws('; ', CASE WHEN missing_pct > 5 THEN format('{{:.1f}}% missing values detected', missing_pct) END,
            CASE WHEN duplicates > 0 THEN format('{{:,}} duplicate entries found', CAST(duplicates AS BIGINT)) END,
            CASE WHEN negatives > 0 THEN format('{{:,}} negative quantity values', CAST(negatives AS BIGINT)) END,
            CASE WHEN avg_points_per_item < 7 THEN format('low data points per item: {{:.1f}} (minimum recommended: 7)', avg_points_per_item) END) AS issue_text
    FROM metrics""", lambda s, d: quality.quality_report(dirty(s, d), COLUMNS).withColumn("issue_text", F.array_join("issues", "; ")))
R.add("q6_score_band", "sku, score:d, band", f"""{DIRTY_PART}, t AS (
    SELECT sku, 100.0 * count(*) FILTER (quantity >= 0) / count(*) AS score FROM demand GROUP BY sku)
    SELECT *, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'fair'
        WHEN score >= 40 THEN 'poor' ELSE 'critical' END AS band FROM t""",
      lambda s, d: dirty(s, d).groupBy("sku").agg((F.count_if(F.col("quantity") >= 0) * 100.0 / F.count("*")).alias("score"))
      .withColumn("band", quality.score_band(F.col("score"))))
R.add("q7_rows_with_missing", ROW, f"{DIRTY_PART} SELECT * FROM demand WHERE quantity IS NULL OR date IS NULL OR sku IS NULL",
      lambda s, d: quality.rows_with_missing(dirty(s, d), ("date", "sku", "quantity")))
R.add("q8_duplicate_rows", ROW, f"{SUPP} SELECT * FROM demand QUALIFY count(*) OVER (PARTITION BY sku, date) > 1",
      lambda s, d: quality.duplicate_rows(demand(s, d, "supp")))
R.add("q9_negative_rows", ROW, f"{DIRTY_PART} SELECT * FROM demand WHERE quantity < 0", lambda s, d: quality.negative_rows(dirty(s, d)))
R.add("q10_outlier_rows", ROW, f"""WITH {events_sql()} SELECT d.* FROM demand d, (SELECT avg(quantity) AS m, stddev_samp(quantity) AS sd FROM demand)
    WHERE abs((quantity - m) / sd) > 3""", lambda s, d: quality.outlier_rows(events(s, d)))
R.add("q11_summary_stats", "total_rows:i, total_items:i, total_categories:i, start_date, end_date, days:i, total_quantity:d, mean_quantity:d, median_quantity:d, std_quantity:d",
      f"""{PART} SELECT count(*) AS total_rows, count(DISTINCT sku) AS total_items, count(DISTINCT category) AS total_categories,
    min(date) AS start_date, max(date) AS end_date, datediff('day', min(date), max(date)) AS days, sum(quantity) AS total_quantity,
    avg(quantity) AS mean_quantity, median(quantity) AS median_quantity, stddev_samp(quantity) AS std_quantity FROM demand""",
      lambda s, d: quality.summary_stats(demand(s, d, category=True)))
FREQUENCY_CASE = """CASE WHEN n < 2 THEN 'unknown' WHEN g <= 1 THEN 'daily' WHEN g BETWEEN 6 AND 8 THEN 'weekly' WHEN g BETWEEN 28 AND 32 THEN 'monthly'
    WHEN g BETWEEN 89 AND 93 THEN 'quarterly' WHEN g BETWEEN 360 AND 370 THEN 'yearly' ELSE 'irregular' END"""
R.add("q12_date_range_info", "start_date, end_date, total_days:i, data_points:i, detected_frequency, coverage_pct:d", f"""{SUPP},
    gaps AS (SELECT date, datediff('day', lag(date) OVER (ORDER BY date), date) AS gap FROM demand),
    r AS (SELECT min(date) AS start_date, max(date) AS end_date, datediff('day', min(date), max(date)) AS total_days, count(*) AS n,
          floor(median(gap)) AS g FROM gaps), f AS (SELECT *, n AS data_points, {FREQUENCY_CASE} AS detected_frequency FROM r)
    SELECT *, CASE WHEN detected_frequency = 'daily' THEN data_points / greatest(1, total_days) * 100 END AS coverage_pct FROM f""",
      lambda s, d: quality.date_range_info(demand(s, d, "supp")))
R.add("q13_item_frequency", "sku, data_points:i, frequency", f"""WITH {demand_sql('part')},
    gaps AS (SELECT sku, datediff('day', lag(date) OVER (PARTITION BY sku ORDER BY date), date) AS gap FROM demand),
    r AS (SELECT sku, count(*) AS n, floor(median(gap)) AS g FROM gaps GROUP BY sku)
    SELECT sku, n AS data_points, {FREQUENCY_CASE} AS frequency FROM r""", lambda s, d: quality.item_frequency(demand(s, d)))

# --- cleaning ---------------------------------------------------------------------------
_AHEAD = "OVER (PARTITION BY sku ORDER BY date, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_AFTER = "OVER (PARTITION BY sku ORDER BY date, row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
R.add("f1_forward_fill", ROW, f"{DIRTY_SUPP} SELECT sku, date, row_id, last_value(quantity IGNORE NULLS) {_AHEAD} AS quantity FROM demand",
      lambda s, d: clean.fill_neighbour(dirty(s, d, "supp"), ["quantity"]))
R.add("f1_backward_fill", ROW, f"{DIRTY_SUPP} SELECT sku, date, row_id, first_value(quantity IGNORE NULLS) {_AFTER} AS quantity FROM demand",
      lambda s, d: clean.fill_neighbour(dirty(s, d, "supp"), ["quantity"], forward=False))
R.add("f2_fill_zero", ROW, f"{DIRTY_PART} SELECT * REPLACE (coalesce(quantity, 0) AS quantity) FROM demand", lambda s, d: clean.fill_zero(dirty(s, d)))
R.add("f3_fill_mean", ROW, f"{DIRTY_PART} SELECT d.* REPLACE (coalesce(quantity, m) AS quantity) FROM demand d, (SELECT avg(quantity) AS m FROM demand)",
      lambda s, d: clean.fill_mean(dirty(s, d), ["quantity"]))
R.add("f4_drop_missing", ROW, f"{DIRTY_PART} SELECT * FROM demand WHERE quantity IS NOT NULL AND sku IS NOT NULL AND date IS NOT NULL",
      lambda s, d: clean.drop_missing(dirty(s, d), ["date", "sku", "quantity"]))
for _method, _agg in (("sum", "coalesce(sum(quantity), 0)"), ("mean", "avg(quantity)")):
    R.add(f"f5_duplicates_{_method}", "sku, date, quantity:d, row_id:i, price:d, promo:i", f"""{DIRTY_SUPP} SELECT sku, date, {_agg} AS quantity,
        min(row_id) AS row_id, arg_min(price, row_id) AS price, arg_min(promo, row_id) AS promo FROM demand GROUP BY sku, date""",
          lambda s, d, m=_method: clean.collapse_duplicates(dirty(s, d, "supp"), m))
R.add("f6_keep_first", ROW, f"{DIRTY_SUPP} SELECT * FROM demand QUALIFY row_number() OVER (PARTITION BY sku, date ORDER BY row_id) = 1",
      lambda s, d: clean.keep_first(dirty(s, d, "supp")))
R.add("f7_negatives_zero", ROW, f"{DIRTY_PART} SELECT * REPLACE (CASE WHEN quantity < 0 THEN 0 ELSE quantity END AS quantity) FROM demand",
      lambda s, d: clean.fix_negatives(dirty(s, d)))
R.add("f7_negatives_absolute", ROW, f"{DIRTY_PART} SELECT * REPLACE (abs(quantity) AS quantity) FROM demand",
      lambda s, d: clean.fix_negatives(dirty(s, d), "absolute"))
_BOUNDS = "(SELECT avg(quantity) AS m, stddev_samp(quantity) AS sd FROM demand)"
R.add("f8_outliers_remove", ROW, f"""{DIRTY_PART} SELECT d.* FROM demand d, {_BOUNDS}
    WHERE NOT coalesce(quantity < m - 1.5 * sd OR quantity > m + 1.5 * sd, false)""",
      lambda s, d: clean.fix_outliers(dirty(s, d), "remove", 1.5))
R.add("f8_outliers_cap", ROW, f"""{DIRTY_PART} SELECT d.* REPLACE (CASE WHEN quantity < m - 1.5 * sd THEN m - 1.5 * sd
    WHEN quantity > m + 1.5 * sd THEN m + 1.5 * sd ELSE quantity END AS quantity) FROM demand d, {_BOUNDS}""",
      lambda s, d: clean.fix_outliers(dirty(s, d), "cap", 1.5))
R.add("f9_all_fixes", "sku, date, quantity:d", f"""{DIRTY_SUPP}, filled AS (
    SELECT sku, date, row_id, last_value(quantity IGNORE NULLS) {_AHEAD} AS quantity FROM demand),
    one AS (SELECT sku, date, coalesce(sum(quantity), 0) AS quantity FROM filled GROUP BY sku, date),
    plus AS (SELECT sku, date, CASE WHEN quantity < 0 THEN 0 ELSE quantity END AS quantity FROM one)
    SELECT p.* FROM plus p, (SELECT avg(quantity) AS m, stddev_samp(quantity) AS sd FROM plus)
    WHERE NOT (quantity < m - 3 * sd OR quantity > m + 3 * sd)""",
      lambda s, d: clean.apply_fixes(dirty(s, d, "supp").drop("category", "price", "promo"),
                                     {"outliers": "remove", "negative": "zero", "missing": "ffill", "duplicates": "sum"}))
R.add("f10_fill_date_gaps", "sku, date, quantity:d", f"""{SUPP}, span AS (SELECT sku, min(date) AS a, max(date) AS b FROM demand GROUP BY sku),
    calendar AS (SELECT sku, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span)
    SELECT sku, date, quantity FROM calendar LEFT JOIN demand USING (sku, date)""",
      lambda s, d: clean.fill_date_gaps(demand(s, d, "supp")))
