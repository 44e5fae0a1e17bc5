"""Anomaly detection and review (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycast.config import AnomalyConfig
from tallycast.operators import anomaly
from tallycast.plans.data import Register, demand, demand_sql, events, events_sql

R = Register()
RECORD = "sku, date, value:d, expected_value:d, anomaly_type, severity:d, method"
EVENTS = "WITH " + events_sql()
SUPP = "WITH " + demand_sql("supp")
RETURNS = "case when l_orderkey % 50 = 0 then -60 - l_quantity else l_quantity end"

# a window of seven that holds the value itself cannot exceed z = 6 / sqrt(7), so the default
# threshold of 2.5 finds nothing; the query uses 2
ROLLING = AnomalyConfig(rolling_threshold=2.0)

IQR_SQL = """fence AS (SELECT sku, quantile_cont(quantity, 0.25) AS q1, quantile_cont(quantity, 0.5) AS q2, quantile_cont(quantity, 0.75) AS q3
        FROM demand GROUP BY sku HAVING count(quantity) >= 4),
    bound AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM fence),
    anomalies AS (SELECT sku, date, quantity AS value, q2 AS expected_value,
        CASE WHEN quantity > high THEN 'spike' WHEN quantity >= 0 THEN 'drop' ELSE 'negative' END AS anomaly_type,
        least(1.0, CASE WHEN quantity > high THEN quantity - high ELSE low - quantity END / (iqr + 1)) AS severity, 'iqr' AS method
        FROM demand JOIN bound USING (sku) WHERE quantity < low OR quantity > high)"""
ZSCORE_SQL = """zscored AS (SELECT sku, date, quantity AS value, m AS expected_value, CASE WHEN quantity > m THEN 'spike' ELSE 'drop' END AS anomaly_type,
        least(1.0, abs(quantity - m) / sd / 6) AS severity, 'zscore' AS method
        FROM (SELECT *, avg(quantity) OVER w AS m, stddev_samp(quantity) OVER w AS sd, count(quantity) OVER w AS n FROM demand WINDOW w AS (PARTITION BY sku))
        WHERE n >= 3 AND sd > 0 AND abs(quantity - m) / sd > 3)"""
ZEROS_SQL = """flat AS (SELECT sku, date, row_id, CASE WHEN date < DATE '1999-01-01' THEN 0 ELSE quantity END AS quantity FROM demand),
    placed AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY date, row_id) AS i,
        row_number() OVER (PARTITION BY sku, quantity = 0 ORDER BY date, row_id) AS j, avg(quantity) OVER (PARTITION BY sku) AS m FROM flat),
    zeros AS (SELECT sku, min(date) AS date, 0.0 AS value, max(m) AS expected_value, 'zero' AS anomaly_type,
        least(1.0, count(*) / 10) AS severity, 'zero_detection' AS method FROM placed WHERE quantity = 0 GROUP BY sku, i - j HAVING count(*) >= 3)"""
GAPS_SQL = """days AS (SELECT DISTINCT sku, date FROM demand),
    nexts AS (SELECT *, lead(date) OVER (PARTITION BY sku ORDER BY date) AS nxt FROM days),
    gaps AS (SELECT sku, date + 1 AS date, 0.0 AS value, 0.0 AS expected_value, 'gap' AS anomaly_type,
        least(1.0, (nxt - date - 1) / 7) AS severity, 'gap_detection' AS method FROM nexts WHERE nxt - date > 1)"""


def _iqr(spark, folder):
    return anomaly.detect_iqr(events(spark, folder))


R.add("a1_iqr", RECORD, f"{EVENTS}, {IQR_SQL} SELECT * FROM anomalies", _iqr)
R.add("a1_iqr_negative", RECORD, f"WITH {demand_sql('supp', quantity=RETURNS)}, {IQR_SQL} SELECT * FROM anomalies",
      lambda s, d: anomaly.detect_iqr(demand(s, d, "supp", quantity=RETURNS)))
R.add("a2_zscore", RECORD, f"{EVENTS}, {ZSCORE_SQL} SELECT * FROM zscored", lambda s, d: anomaly.detect_zscore(events(s, d)))
R.add("a3_rolling", RECORD, f"""{SUPP}, r AS (SELECT *, avg(quantity) OVER w AS m, stddev_samp(quantity) OVER w AS sd, count(quantity) OVER w AS k,
        count(*) OVER (PARTITION BY sku) AS n FROM demand WINDOW w AS (PARTITION BY sku ORDER BY date, row_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
    SELECT sku, date, quantity AS value, m AS expected_value, CASE WHEN quantity > m THEN 'spike' ELSE 'drop' END AS anomaly_type,
        least(1.0, abs(quantity - m) / sd / 4) AS severity, 'rolling' AS method FROM r WHERE k = 7 AND n >= 8 AND sd > 0 AND abs(quantity - m) / sd > 2""",
      lambda s, d: anomaly.detect_rolling(demand(s, d, "supp"), ROLLING))


def _flat(spark, folder):
    """No supplier has zeros of its own, so its early history is set to zero."""
    df = demand(spark, folder, "part")
    return df.withColumn("quantity", F.expr("case when date < date '1999-01-01' then 0D else quantity end"))


PART = "WITH " + demand_sql("part")
R.add("a4_zero_runs", RECORD, f"{PART}, {ZEROS_SQL} SELECT * FROM zeros", lambda s, d: anomaly.detect_zeros(_flat(s, d)))
R.add("a5_gaps_daily", RECORD, f"{SUPP}, {GAPS_SQL} SELECT * FROM gaps", lambda s, d: anomaly.detect_gaps(demand(s, d, "supp")))
R.add("a5_gaps_monthly", RECORD, f"""{SUPP}, days AS (SELECT DISTINCT sku, date FROM demand),
    span AS (SELECT sku, min(date) AS a, max(date) AS b FROM days GROUP BY sku),
    labels AS (SELECT sku, b, last_day(CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE)) AS date FROM span),
    missing AS (SELECT sku, date, year(date) * 12 + month(date) AS i FROM labels WHERE date <= b AND (sku, date) NOT IN (SELECT (sku, date) FROM days)),
    runs AS (SELECT *, i - row_number() OVER (PARTITION BY sku ORDER BY i) AS run FROM missing)
    SELECT sku, min(date) AS date, 0.0 AS value, 0.0 AS expected_value, 'gap' AS anomaly_type, least(1.0, count(*) / 7) AS severity,
        'gap_detection' AS method FROM runs GROUP BY sku, run""", lambda s, d: anomaly.detect_gaps(demand(s, d, "supp"), "M"))
MANY = f"""{EVENTS}, {IQR_SQL}, {ZSCORE_SQL}, {GAPS_SQL},
    everything AS (SELECT * FROM anomalies UNION ALL SELECT * FROM zscored UNION ALL SELECT * FROM gaps)"""


def _many(spark, folder):
    return anomaly.detect_many(events(spark, folder), ("iqr", "zscore", "gaps"))


R.add("a6_batch", RECORD, f"{MANY} SELECT * FROM everything", _many)
R.add("a7_playlist", RECORD, f"{MANY} SELECT * FROM everything WHERE severity >= 0.3", lambda s, d: anomaly.playlist(_many(s, d), 0.3))
R.add("a8_summary", "total_anomalies:i, items_with_anomalies:i, avg_severity:d, types", f"""{MANY}, t AS (
    SELECT anomaly_type, count(*) AS n FROM everything GROUP BY anomaly_type)
    SELECT count(*) AS total_anomalies, count(DISTINCT sku) AS items_with_anomalies, avg(severity) AS avg_severity,
        (SELECT string_agg(anomaly_type || '=' || n, ',' ORDER BY anomaly_type) FROM t) AS types FROM everything""",
      lambda s, d: anomaly.summary(_many(s, d)).withColumn("types", F.expr(
          "array_join(transform(map_entries(by_type), e -> concat(e.key, '=', e.value)), ',')")))
R.add("a8_count_by_type", "anomaly_type, anomalies:i", f"{MANY} SELECT anomaly_type, count(*) AS anomalies FROM everything GROUP BY anomaly_type",
      lambda s, d: anomaly.count_by_type(_many(s, d)))
R.add("a9_export", "sku, date, value:d, expected:d, type, severity:d, method, description, action", f"""{MANY}
    SELECT *, expected_value AS expected, anomaly_type AS type, 'Pending' AS action, CASE anomaly_type WHEN 'spike' THEN 'Unusual high value'
        WHEN 'drop' THEN 'Unusual low value' WHEN 'gap' THEN 'Missing data period' WHEN 'negative' THEN 'Negative value detected' END AS description
    FROM everything""", lambda s, d: anomaly.export(_many(s, d)))
R.add("a10_filter", RECORD, f"{MANY} SELECT * FROM everything WHERE anomaly_type = 'spike' AND severity >= 0.4 AND contains(sku || '|' || date || '|' || method, '-1')",
      lambda s, d: anomaly.filter_anomalies(_many(s, d), "spike", "medium", "-1"))
R.add("a11_deviation", RECORD + ", deviation:d, deviation_pct:d", f"""{MANY} SELECT *, value - expected_value AS deviation,
    CASE WHEN expected_value = 0 THEN 0 ELSE (value - expected_value) / expected_value * 100 END AS deviation_pct FROM everything""",
      lambda s, d: anomaly.with_deviation(_many(s, d)))

# review: the severest are corrected, items ending in 7 lose theirs, some are flagged
ACTION = """case when severity >= 0.9 then 'Auto-correct' when sku like '%7' then 'Remove' when sku like '%3' then 'Flag' else 'Pending' end"""
REVIEW = f"{EVENTS}, {IQR_SQL}, reviewed AS (SELECT *, {ACTION} AS action FROM anomalies)"


def _reviewed(spark, folder):
    return _iqr(spark, folder).withColumn("action", F.expr(ACTION))


ROW = "sku, date, quantity:d, row_id:i"
CORRECT_SQL = """corrected AS (SELECT d.sku, d.date, d.row_id, coalesce(n.expected_value, d.quantity) AS quantity FROM demand d LEFT JOIN (
    SELECT sku, date, expected_value FROM reviewed WHERE action = 'Auto-correct'
    QUALIFY row_number() OVER (PARTITION BY sku, date ORDER BY severity DESC, value) = 1) n USING (sku, date))"""
R.add("a12_corrections", ROW, f"{REVIEW}, {CORRECT_SQL} SELECT * FROM corrected",
      lambda s, d: anomaly.apply_corrections(events(s, d), _reviewed(s, d).filter("action = 'Auto-correct'")))
R.add("a13_removals", ROW, f"{REVIEW} SELECT * FROM demand d WHERE NOT EXISTS (SELECT 1 FROM reviewed r WHERE action = 'Remove' AND r.sku = d.sku AND r.date = d.date)",
      lambda s, d: anomaly.apply_removals(events(s, d), _reviewed(s, d).filter("action = 'Remove'")))
R.add("a13_apply_actions", ROW, f"""{REVIEW}, {CORRECT_SQL} SELECT * FROM corrected d
    WHERE NOT EXISTS (SELECT 1 FROM reviewed r WHERE action = 'Remove' AND r.sku = d.sku AND r.date = d.date)""",
      lambda s, d: anomaly.apply_actions(events(s, d), _reviewed(s, d)))
R.add("a14_action_counts", "action, anomalies:i", f"{REVIEW} SELECT action, count(*) AS anomalies FROM reviewed WHERE action <> 'Pending' GROUP BY action",
      lambda s, d: anomaly.action_counts(_reviewed(s, d)))
R.add("a14_flagged_items", "sku", f"{REVIEW} SELECT DISTINCT sku FROM reviewed WHERE action = 'Flag'", lambda s, d: anomaly.flagged_items(_reviewed(s, d)))
