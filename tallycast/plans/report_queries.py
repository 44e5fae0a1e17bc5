"""Reports, watch-lists and stage tables (E, K, S)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.operators import anomaly, classify, forecast, profile, quality, report, series, stages
from tallycast.operators.conform import conform
from tallycast.plans.anomaly_queries import IQR_SQL
from tallycast.plans.classify_queries import cluster_sql
from tallycast.plans.data import RAW_SQL, Register, demand, demand_sql, events, events_sql, raw_sales
from tallycast.plans.forecast_queries import ERRORS, FIVE_SQL, LONG, backtest_sql, choice_sql
from tallycast.plans.forecast_sql import long_sql, naive_sql, seasonal_naive_sql, series_sql
from tallycast.config import COMPARED_MODELS
from tallycast.schema import Mapping
from tallycast.sources.files import EXACT_CSV, load, read_bundle, read_csv, write_csv, write_parquet

R = Register()
H = 12
SUPP = "WITH " + demand_sql("supp")
RESULTS = f"{SUPP}, {series_sql('W')}, {naive_sql(H)}, {seasonal_naive_sql(52, H)}, {choice_sql(('naive', 'seasonal_naive'))}"
RESULTS += ", sums AS (SELECT *, list_sum(forecast) AS total_forecast, len(forecast) AS periods FROM results)"


def _supp(spark, folder):
    return demand(spark, folder, "supp")


def _results(spark, folder):
    return forecast.forecast(_supp(spark, folder), ("naive", "seasonal_naive"), H * 7, "W")


R.add("e1_forecast_table", "sku, date, forecast:d, model, lower_bound:d, upper_bound:d", f"{RESULTS} {long_sql('results', 'W')}",
      lambda s, d: report.forecast_table(_results(s, d)))
R.add("e2_forecast_summary", "sku, model, frequency, periods:i, total_forecast:d, avg_period_forecast:d, mape:d, mae:d, forecast_start, forecast_end", f"""{RESULTS}
    SELECT s.*, 'Weekly' AS frequency, total_forecast / periods AS avg_period_forecast, last_period + 7 AS forecast_start, last_period + {7 * H} AS forecast_end
    FROM sums s JOIN packed USING (sku)""", lambda s, d: report.forecast_summary(_results(s, d)))
R.add("e3_model_performance", ERRORS, f"{RESULTS} SELECT * FROM results", lambda s, d: report.model_performance(_results(s, d)))
R.add("e4_comparison_report", "model, avg_mape:d, avg_mae:d, win_rate:d", f"{SUPP}, {backtest_sql('M', H, FIVE_SQL, COMPARED_MODELS)} SELECT * FROM comparison",
      lambda s, d: report.comparison_report(forecast.compare_models(_supp(s, d), H, "M", None)))
R.add("e5_executive_summary", "total_items:i, total_forecast:d, avg_mape:d, forecast_horizon:i, large_items_pct:d", f"""{RESULTS}
    SELECT count(*) AS total_items, sum(total_forecast) AS total_forecast, avg(mape) AS avg_mape, max(periods) AS forecast_horizon,
        avg(CAST(total_forecast > 1000 AS INT)) * 100 AS large_items_pct FROM sums""", lambda s, d: report.executive_summary(_results(s, d)))
R.add("e5_top_items", "sku, model, total_forecast:d, mape:d", f"{RESULTS} SELECT * FROM sums ORDER BY total_forecast DESC, sku LIMIT 10",
      lambda s, d: report.top_items(_results(s, d)))
STATUS = "CASE WHEN mape < 15 THEN 'Good' WHEN mape < 30 THEN 'Fair' ELSE 'Review' END"
R.add("e7_status", "sku, model, total_forecast:d, mape:d, mae:d, status", f"{RESULTS} SELECT *, {STATUS} AS status FROM sums", lambda s, d: report.with_status(_results(s, d)))
R.add("e8_result_summary", "total_items:i, total_forecast:d, avg_mape:d, statuses, models", f"""{RESULTS}
    SELECT count(*) AS total_items, sum(total_forecast) AS total_forecast, avg(mape) AS avg_mape,
        (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT {STATUS} AS k, count(*) AS n FROM sums GROUP BY k)) AS statuses,
        (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT model AS k, count(*) AS n FROM sums GROUP BY k)) AS models FROM sums""",
      lambda s, d: report.result_summary(_results(s, d)).withColumns({
          name: F.expr(f"array_join(transform(map_entries({source}), e -> concat(e.key, '=', e.value)), ',')")
          for name, source in (("statuses", "status_distribution"), ("models", "model_distribution"))}))
R.add("e8_model_distribution", "model, items:i", f"{RESULTS} SELECT model, count(*) AS items FROM results GROUP BY model", lambda s, d: report.model_distribution(_results(s, d)))
R.add("e9_problem_items", "sku, model, mape:d", f"{RESULTS} SELECT * FROM results WHERE mape > 150", lambda s, d: report.problem_items(_results(s, d), 150))
CLUSTERED = f"{RESULTS}, c AS (SELECT sku, volume_tier FROM (WITH {cluster_sql('supp')} SELECT * FROM clusters))"
R.add("e10_filter_results", ERRORS, f"{CLUSTERED} SELECT * FROM results WHERE sku IN (SELECT sku FROM c WHERE volume_tier = 'B') AND mape >= 30",
      lambda s, d: report.filter_results(_results(s, d), classify.select_clusters(classify.cluster_items(_supp(s, d)), "B"), "Review"))
R.add("e11_first_periods", LONG, f"{RESULTS} SELECT * FROM ({long_sql('results', 'W')}) WHERE step <= 10", lambda s, d: report.edge_periods(_results(s, d), "first"))
R.add("e11_last_periods", LONG, f"{RESULTS} SELECT * FROM ({long_sql('results', 'W')}) WHERE step > {H} - 10", lambda s, d: report.edge_periods(_results(s, d), "last"))
JOINED = f"{RESULTS}, joined AS (SELECT sku, period AS date, y, 'history' AS kind FROM series UNION ALL SELECT sku, date, forecast, 'forecast' FROM ({long_sql('results', 'W')}))"
R.add("e12_history_and_forecast", "sku, date, y:d, kind", f"{JOINED} SELECT * FROM joined", lambda s, d: report.history_and_forecast(_supp(s, d), _results(s, d), "W"))
R.add("e13_top_export", ERRORS, f"{RESULTS} SELECT * FROM sums ORDER BY total_forecast DESC, sku LIMIT 25", lambda s, d: report.export_items(_results(s, d), "top", top=25))
R.add("e14_last_days", "sku, date, y:d, kind", f"{JOINED} SELECT * FROM joined QUALIFY date >= max(date) OVER (PARTITION BY sku) - 180",
      lambda s, d: report.last_days(report.history_and_forecast(_supp(s, d), _results(s, d), "W"), 180))

# --- watch-lists and session ------------------------------------------------------------


def _bookmarks(spark, folder):
    """Every event marks its user; the kind of event is the note."""
    marks = spark.read.parquet(f"{folder}/events.parquet").select(
        F.col("user_id").cast("string").alias("sku"), F.col("event_type").alias("note"), F.col("ts").alias("added_at"))
    early = F.col("added_at") < F.lit("2024-01-15").cast("timestamp_ntz")
    return stages.add_bookmarks(marks.filter(early), marks.filter(~early))


BOOKMARKS = "bookmarks AS (SELECT CAST(user_id AS VARCHAR) AS sku, arg_max(event_type, ts) AS note, min(ts) AS added_at FROM events GROUP BY user_id)"
R.add("k1_add_bookmarks", "sku, note, added_at", f"WITH {BOOKMARKS} SELECT * REPLACE (strftime(added_at, '%Y-%m-%d %H:%M:%S') AS added_at) FROM bookmarks",
      lambda s, d: _bookmarks(s, d).withColumn("added_at", F.date_format("added_at", "yyyy-MM-dd HH:mm:ss")))
R.add("k1_remove_bookmarks", "sku, note", f"WITH {BOOKMARKS}, {events_sql()}, {IQR_SQL} SELECT * FROM bookmarks WHERE sku NOT IN (SELECT sku FROM anomalies WHERE severity >= 1)",
      lambda s, d: stages.remove_bookmarks(_bookmarks(s, d), anomaly.detect_iqr(events(s, d)).filter("severity >= 1")))
R.add("k1_is_bookmarked", "sku, is_bookmarked", f"WITH {BOOKMARKS}, {demand_sql('part')} SELECT DISTINCT sku, sku IN (SELECT sku FROM bookmarks) AS is_bookmarked FROM demand",
      lambda s, d: stages.with_bookmarked(demand(s, d).select("sku").distinct(), _bookmarks(s, d)))
R.add("k2_flag_items", "sku", f"WITH {events_sql()}, {IQR_SQL} SELECT sku FROM anomalies WHERE severity >= 1 UNION SELECT sku FROM demand WHERE quantity > 200",
      lambda s, d: stages.flag_items(anomaly.detect_iqr(events(s, d)).filter("severity >= 1"), events(s, d).filter("quantity > 200")))


def _session(spark, folder):
    df = events(spark, folder)
    results = forecast.forecast(df, ["naive"], 7, "D")
    return stages.session_summary(df, anomaly.detect_iqr(df), results, _bookmarks(spark, folder), quality.quality_report(df, ("date", "sku", "quantity")))


R.add("k3_session_summary", "rows:i, skus:i, categories:i, quality_score:d, forecasts_count:i, anomalies_count:i, bookmarks_count:i", f"""WITH {BOOKMARKS}, {events_sql()}, {IQR_SQL},
    dup AS (SELECT count(*) - count(DISTINCT (sku, date)) AS n FROM demand)
    SELECT count(*) AS rows, count(DISTINCT sku) AS skus, count(DISTINCT category) AS categories,
        100 - least(15, 2.0 * (SELECT n FROM dup) / count(*) * 100) AS quality_score, count(DISTINCT sku) AS forecasts_count,
        (SELECT count(*) FROM anomalies) AS anomalies_count, (SELECT count(*) FROM bookmarks) AS bookmarks_count FROM demand""", _session)


def _series_facts(sku: str, ys) -> dict:
    zeros = sum(1 for y in ys if y == 0)
    return {"sku": sku, "periods": len(ys), "peak": float(max(ys)), "zero_share": zeros / len(ys)}


R.add("k5_apply_per_item", "sku, periods:i, peak:d, zero_share:d", f"""{SUPP}, {series_sql('W')}
    SELECT sku, n AS periods, list_max(ys) AS peak, len(list_filter(ys, lambda y: y = 0)) / n AS zero_share FROM packed""",
      lambda s, d: stages.apply_per_item(series.pack(_supp(s, d), "W"), _series_facts, "sku string, periods long, peak double, zero_share double"))

# --- files: written to the shared folder of the cluster and read back ---------------------


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder; a local session may do without one, a cluster may not."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        shared = tempfile.mkdtemp()
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


RAW_ROW = "row_id:i, trx_date, product_id, category_group, sales_qty:d, unit_price:d, is_promo"
RAW = f"WITH {RAW_SQL} SELECT * FROM raw"


def _through_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    write_csv(raw_sales(spark, folder), path)
    return read_csv(spark, path)


def _through_latin1(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    accented = raw_sales(spark, folder).withColumn("category_group", F.concat("category_group", F.lit("-été")))
    accented.write.options(**EXACT_CSV, encoding="ISO-8859-1").csv(path)
    return read_csv(spark, path)


def _through_parquet(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    write_parquet(raw_sales(spark, folder), path, partition_by=["category_group"])
    return load(spark, path, "parquet")


R.add("s1_csv_scan", RAW_ROW, RAW, _through_csv)
R.add("s2_csv_latin1", RAW_ROW, f"WITH {RAW_SQL} SELECT * REPLACE (category_group || '-' || chr(233) || 't' || chr(233) AS category_group) FROM raw", _through_latin1)
R.add("s4_load_by_format", RAW_ROW, RAW, lambda s, d: load(s, _written_csv(s, d), "csv"))
R.add("s6_parquet_sink", RAW_ROW, RAW, _through_parquet)


def _written_csv(spark: SparkSession, folder: str) -> str:
    path = scratch(spark)
    write_csv(raw_sales(spark, folder), path)
    return path


R.add("s5_csv_sink", "sku, volume_tier, total_volume:d", f"WITH {cluster_sql()} SELECT * FROM clusters", lambda s, d: _csv_of(s, classify.cluster_items(demand(s, d))))


def _csv_of(spark: SparkSession, table: DataFrame) -> DataFrame:
    path = scratch(spark)
    write_csv(table, path)
    return read_csv(spark, path)


ODD_TEXT = """concat(p_type, case p_partkey % 7 when 0 then concat(chr(10), 'next') when 1 then ' "quoted", ' when 2 then chr(9) else '' end)"""


def _odd_text(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Texts with blanks at the edges, line breaks, quotes and commas; empty texts and nulls."""
    path = scratch(spark)
    odd = spark.read.parquet(f"{folder}/part.parquet").selectExpr(
        "p_partkey", f"{ODD_TEXT} as wild", "case when p_partkey % 5 = 0 then '' when p_partkey % 5 = 1 then null else concat('  ', p_brand, ' ') end as edge")
    write_csv(odd, path)
    return read_csv(spark, path, **options)


ODD_SQL = f"""SELECT p_partkey, {ODD_TEXT} AS wild,
    CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN NULL ELSE concat('  ', p_brand, ' ') END AS edge FROM part"""
R.add("s5_csv_odd_text", "p_partkey:i, wild, edge", ODD_SQL, _odd_text)
R.add("s1_csv_records", "p_partkey:i, wild, edge", ODD_SQL, lambda s, d: _odd_text(s, d, row_id="row_id"))


def _csv_to_demand(spark: SparkSession, folder: str) -> DataFrame:
    """From a CSV file to the canonical schema, the roles found by the profile."""
    path = scratch(spark)
    write_csv(raw_sales(spark, folder).withColumn("product_id", F.trim("product_id")), path)
    raw = load(spark, path, "csv").withColumn("row_id", F.col("row_id").cast("long"))
    found = profile.to_mapping(profile.best_mapping(profile.profile(raw)), raw)
    return conform(raw, found, "row_id")


R.add("p11_csv_mapping", "sku, date, quantity:d, row_id:i, promo:i", f"""WITH {RAW_SQL} SELECT trim(product_id) AS sku,
    CAST(try_strptime(trx_date, '%d/%m/%Y') AS DATE) AS date, sales_qty AS quantity, row_id, CASE WHEN is_promo = 'yes' THEN 1 ELSE 0 END AS promo FROM raw""", _csv_to_demand)


def _bundle(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    report.write_report(_results(spark, folder), path)
    return read_bundle(spark, path, ["summary", "forecasts", "model_performance"])["forecasts"]


R.add("e6_report_bundle", "sku, date, forecast:d, model, lower_bound:d, upper_bound:d", f"{RESULTS} {long_sql('results', 'W')}", _bundle)


def _stages(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    raw = raw_sales(spark, folder)
    mapping = Mapping("trx_date", "product_id", "sales_qty", "category_group", "unit_price", "is_promo")
    processed = conform(raw, mapping, "row_id")
    stages.save_stages(spark, path, {"processed": processed, "clusters": classify.cluster_items(processed)}, mapping)
    tables, _ = stages.load_stages(spark, path)
    return tables["processed"].join(tables["clusters"].select("sku", "volume_tier"), "sku")


R.add("k4_save_and_load", "sku, row_id:i, quantity:d, category, volume_tier", f"""WITH {cluster_sql()}, typed_parts AS (SELECT CAST(p_partkey AS VARCHAR) AS sku, p_type FROM part)
    SELECT 'P-' || sku AS sku, row_id, quantity, p_type AS category, volume_tier FROM demand JOIN clusters USING (sku) JOIN typed_parts USING (sku)""", _stages)
