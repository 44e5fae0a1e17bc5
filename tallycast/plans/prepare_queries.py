"""Sources, column profiling and conforming (S, P, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycast.config import DATE_FORMATS, PROMO_WORDS, REQUIRED_ROLES, ROLE_KEYWORDS, ROLES
from tallycast.functions.dates import date_text, parse_date, period_label
from tallycast.operators import conform, profile
from tallycast.plans.data import RAW_SQL, Register, demand, demand_sql, raw_sales, table
from tallycast.sources.files import load, preview

R = Register()
PART = "WITH " + demand_sql("part", category=True)
ROW = "sku, date, quantity:d, row_id:i"

# --- sources ----------------------------------------------------------------------------
R.add("s3_parquet_scan", "p_partkey:i, p_type, p_retailprice:d", "SELECT p_partkey, p_type, p_retailprice FROM part",
      lambda s, d: load(s, f"{d}/part.parquet"))
R.add("s7_preview", ROW, f"{PART} SELECT * FROM demand ORDER BY row_id LIMIT 1000",
      lambda s, d: preview(demand(s, d)))

# --- profiling --------------------------------------------------------------------------
KINDS = {"trx_date": "object", "product_id": "object", "category_group": "object", "sales_qty": "float",
         "unit_price": "float", "is_promo": "object"}


def _keyword_sql(role: str, points: float) -> str:
    tests = " OR ".join(f"contains(lower(trim(col)), '{word}')" for word in ROLE_KEYWORDS[role])
    return f"CASE WHEN {tests} THEN {points} ELSE 0.0 END"


FORMAT_LIST = "[" + ", ".join(f"'{name}'" for name, _ in DATE_FORMATS) + "]"


def parse_sql(text: str) -> str:
    return f"coalesce(CAST(try_strptime(trim({text}), {FORMAT_LIST}) AS DATE), CAST(TRY_CAST(trim({text}) AS TIMESTAMP) AS DATE))"


SAMPLE_SQL = " UNION ALL ".join(
    f"SELECT * FROM (SELECT {i + 1} AS pos, '{name}' AS col, '{kind}' AS kind, row_id, "
    f"row_number() OVER (ORDER BY row_id) AS rank, CAST({name} AS VARCHAR) AS value "
    f"FROM raw WHERE {name} IS NOT NULL ORDER BY row_id LIMIT 100)"
    for i, (name, kind) in enumerate(KINDS.items())
)
STATS_SQL = f"""WITH {RAW_SQL}, sample AS ({SAMPLE_SQL}), stats AS (
    SELECT pos, col, kind, count(*) AS n, count(DISTINCT value) AS u,
        coalesce(avg(CASE WHEN rank <= 20 THEN CAST({parse_sql('value')} IS NOT NULL AS INT) END), 0) AS date_share,
        coalesce(avg(CASE WHEN rank <= 20 THEN CAST(regexp_full_match(value, '[A-Za-z0-9\\-_]+') AS INT) END), 0) AS code_share,
        coalesce(avg(CAST(TRY_CAST(value AS DOUBLE) >= 0 AS INT)), 0) AS nonneg,
        coalesce(avg(CAST(TRY_CAST(value AS DOUBLE) = floor(TRY_CAST(value AS DOUBLE)) AS INT)), 0) AS whole,
        coalesce(avg(CAST(TRY_CAST(value AS DOUBLE) > 0 AS INT)), 0) AS positive,
        coalesce(avg(CASE WHEN TRY_CAST(value AS DOUBLE) IS NOT NULL THEN CAST(regexp_matches(value, '\\.[0-9][0-9]$') AS INT) END), 0) AS cents,
        avg(CAST(lower(value) IN ({', '.join(f"'{w}'" for w in PROMO_WORDS)}) AS INT)) AS binary_share
    FROM sample GROUP BY pos, col, kind), scored AS (
    SELECT pos, col, kind,
        least(1.0, {_keyword_sql('date', 0.4)} + CASE WHEN kind = 'datetime' THEN 0.5 WHEN kind = 'object' THEN date_share * 0.4 ELSE 0 END) AS date_score,
        least(1.0, {_keyword_sql('sku', 0.4)} + CASE WHEN u / n > 0.01 AND u / n < 0.5 THEN 0.3 ELSE 0 END
            + CASE WHEN kind = 'object' THEN 0.2 + code_share * 0.2 ELSE 0 END) AS sku_score,
        least(1.0, {_keyword_sql('quantity', 0.4)} + CASE WHEN kind IN ('int', 'float') THEN 0.3 + nonneg * 0.15 + whole * 0.15 ELSE 0 END) AS quantity_score,
        least(1.0, {_keyword_sql('category', 0.4)} + CASE WHEN u / n < 0.1 THEN 0.3 WHEN u / n < 0.3 THEN 0.2 ELSE 0 END
            + CASE WHEN kind = 'object' THEN 0.2 ELSE 0 END) AS category_score,
        least(1.0, {_keyword_sql('price', 0.4)} + CASE WHEN kind = 'float' THEN 0.3 + positive * 0.2 + cents * 0.1 ELSE 0 END) AS price_score,
        least(1.0, {_keyword_sql('promo', 0.5)} + CASE WHEN u <= 5 THEN 0.3 ELSE 0 END + binary_share * 0.2) AS promo_score
    FROM stats), best AS (
    SELECT *, greatest(date_score, sku_score, quantity_score, category_score, price_score, promo_score) AS confidence FROM scored),
    profiled AS (
    SELECT *, col AS "column", CASE WHEN confidence < 0.7 THEN 'unknown'
        {' '.join(f"WHEN {role}_score = confidence THEN '{role}'" for role in ROLES)} END AS detected_type FROM best)"""


def _profiled(spark, folder):
    return profile.profile(raw_sales(spark, folder))


R.add("p1_profile", "column, kind, detected_type, confidence:d", f"{STATS_SQL} SELECT * FROM profiled", _profiled)
for _number, _role in enumerate(ROLES, start=2):
    R.add(f"p{_number}_{_role}_score", f"column, {_role}_score:d", f"{STATS_SQL} SELECT * FROM profiled", _profiled)


def _mapping_rows(spark, folder):
    profiled = _profiled(spark, folder)
    mapping = profile.best_mapping(profiled)
    pairs = F.array(*[F.struct(F.lit(role).alias("role"), F.lit(name).alias("name")) for role, name in mapping.items()])
    return spark.range(1).select(F.inline(pairs)).withColumnRenamed("name", "column")


def _greedy_sql() -> str:
    """Each role in turn takes the best column that earlier roles left."""
    taken: list[str] = []
    ctes = []
    for role in ROLES:
        used = "".join(f" AND col NOT IN (SELECT col FROM pick_{name})" for name in taken)
        ctes.append(f"pick_{role} AS (SELECT '{role}' AS role, col FROM profiled WHERE {role}_score >= 0.7{used} "
                    f"ORDER BY {role}_score DESC, pos LIMIT 1)")
        taken.append(role)
    union = " UNION ALL ".join(f"SELECT * FROM pick_{role}" for role in ROLES)
    return f"{STATS_SQL}, {', '.join(ctes)} SELECT role, col AS \"column\" FROM ({union})"


R.add("p8_best_mapping", "role, column", _greedy_sql(), _mapping_rows)
def _mapping_errors(spark, folder):
    """The detected mapping, spoilt in the ways that P10 must notice."""
    found, raw = profile.best_mapping(_profiled(spark, folder)), raw_sales(spark, folder)
    spoilt = {f"no {role}": {r: c for r, c in found.items() if r != role} for role in REQUIRED_ROLES}
    spoilt |= {f"other {role}": found | {role: found[role] + "_x"} for role in found}
    spoilt |= {"date twice": found | {"quantity": found["date"]}, "right": found}
    rows = [(case, i, error) for case, mapping in spoilt.items() for i, error in enumerate(profile.validate_mapping(mapping, raw))]
    return spark.createDataFrame(rows, "case string, place int, error string")


R.add("p10_mapping_errors", "case, place:i, error", f"""WITH best AS (SELECT * FROM ({_greedy_sql()}))
    SELECT 'no ' || role AS "case", 0 AS place, CASE role WHEN 'date' THEN 'Date' WHEN 'sku' THEN 'Item/SKU' ELSE 'Quantity/Sales' END
        || ' column is required' AS error FROM best WHERE role IN ('date', 'sku', 'quantity')
    UNION ALL SELECT 'other ' || role, 0, 'Column ''' || "column" || '_x'' not found in data' FROM best
    UNION ALL SELECT 'date twice', 0, 'Column ''' || "column" || ''' is mapped twice' FROM best WHERE role = 'date'""", _mapping_errors)
R.add("p9_detection_summary", "column, type, confidence:d, message, status", f"""{STATS_SQL}
    SELECT "column", detected_type AS type, confidence,
        CASE WHEN detected_type = 'unknown' THEN 'Could not determine type for ''' || col || ''''
             WHEN confidence >= 0.8 THEN '''' || col || ''' looks like your ' || upper(detected_type) || ' column'
             ELSE '''' || col || ''' might be your ' || upper(detected_type) || ' column' END AS message,
        CASE WHEN detected_type = 'unknown' THEN 'warning' WHEN confidence >= 0.8 THEN 'good' ELSE 'uncertain' END AS status
    FROM profiled""", lambda s, d: profile.detection_summary(_profiled(s, d)))

# --- conforming -------------------------------------------------------------------------
USER_MAPPING = {"date": "trx_date", "sku": "product_id", "quantity": "sales_qty", "price": "unit_price", "promo": "is_promo"}


def _conformed(spark, folder):
    """P10 checks the mapping before C1 builds the plan."""
    raw = raw_sales(spark, folder)
    return conform.conform(raw, profile.to_mapping(USER_MAPPING, raw), "row_id")


R.add("c1_conform", "row_id:i, date, sku, quantity:d, category, price:d, promo:i", f"""WITH {RAW_SQL}
    SELECT row_id, {parse_sql('trx_date')} AS date, trim(product_id) AS sku, sales_qty AS quantity,
           substring(trim(product_id), 1, 3) AS category, unit_price AS price, CASE WHEN is_promo = 'yes' THEN 1 ELSE 0 END AS promo
    FROM raw WHERE {parse_sql('trx_date')} IS NOT NULL""", _conformed)
R.add("c2_item_rows", ROW, f"{PART} SELECT * FROM demand WHERE sku = '77'", lambda s, d: conform.item_rows(demand(s, d), "77"))
R.add("c3_rows_of_items", ROW, f"{PART} SELECT * FROM demand WHERE sku IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_brand = 'Brand#4')",
      lambda s, d: conform.rows_of_items(demand(s, d), table(s, d, "part").filter("p_brand = 'Brand#4'")
                                         .select(F.col("p_partkey").cast("string").alias("sku"))))
R.add("c4_search", "sku, date, category, row_id:i",
      f"{PART} SELECT * FROM demand WHERE contains(lower(concat_ws(chr(1), sku, CAST(date AS VARCHAR), category)), '99-04-1')",
      lambda s, d: conform.search(demand(s, d, category=True), " 99-04-1 ", ["sku", "date", "category"]))
R.add("c5_sort", "sku, total:d", f"{PART} SELECT sku, sum(quantity) AS total FROM demand GROUP BY sku ORDER BY total DESC, sku",
      lambda s, d: conform.sort_by(demand(s, d).groupBy("sku").agg(F.sum("quantity").alias("total")), "total", True, ["sku"]))
R.add("c6_category_items", "category, sku", f"{PART} SELECT DISTINCT category, sku FROM demand",
      lambda s, d: conform.category_items(demand(s, d, category=True)))
R.add("c6_items", "sku, category", f"{PART} SELECT sku, min(category) AS category FROM demand GROUP BY sku",
      lambda s, d: conform.items(demand(s, d, category=True)))
R.add("c6_categories", "category", f"{PART} SELECT DISTINCT category FROM demand",
      lambda s, d: conform.categories(demand(s, d, category=True)))

_STYLES = [("%Y-%m-%d", "yyyy-MM-dd"), ("%d/%m/%Y", "dd/MM/yyyy"), ("%Y/%m/%d", "yyyy/MM/dd"), ("%d-%m-%Y", "dd-MM-yyyy"),
           ("%Y%m%d", "yyyyMMdd"), ("%d.%m.%Y", "dd.MM.yyyy"), ("%b %d, %Y", "MMM dd, yyyy"), ("%d %B %Y", "dd MMMM yyyy"),
           ("%Y-%m-%dT%H:%M:%S", "yyyy-MM-dd'T'HH:mm:ss")]


def _mixed(spark, folder):
    """Order dates written in nine ways, by order key."""
    text = F.lit("no date")
    for i, (_, style) in enumerate(_STYLES):
        text = F.when(F.col("o_orderkey") % 10 == i, F.date_format("o_orderdate", style)).otherwise(text)
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"), text.alias("order_date"))


MIXED_SQL = "WITH mixed AS (SELECT o_orderkey AS row_id, CASE o_orderkey % 10 " + " ".join(
    f"WHEN {i} THEN strftime(o_orderdate, '{style}')" for i, (style, _) in enumerate(_STYLES)
) + " ELSE 'no date' END AS order_date FROM orders)"

R.add("c7_parse_date", "row_id:i, date", f"{MIXED_SQL} SELECT row_id, {parse_sql('order_date')} AS date FROM mixed",
      lambda s, d: _mixed(s, d).withColumn("date", parse_date(F.col("order_date"))))


def _share_sql(column: str, source: str) -> str:
    head = f"(SELECT {column} AS v FROM {source} WHERE {column} IS NOT NULL ORDER BY row_id LIMIT 100)"
    return " UNION ALL ".join(
        f"SELECT {i} AS format_rank, '{name}' AS format, avg(CAST(try_strptime(trim(v), '{name}') IS NOT NULL AS INT)) AS share FROM {head}"
        for i, (name, _) in enumerate(DATE_FORMATS)
    )


R.add("c8_format_shares", "format_rank:i, format, share:d", f"WITH {RAW_SQL} {_share_sql('trx_date', 'raw')}",
      lambda s, d: conform.format_shares(raw_sales(s, d), "trx_date"))
R.add("c8_detect_format", "format, share:d", f"""WITH {RAW_SQL}, shares AS ({_share_sql('trx_date', 'raw')})
    SELECT CASE WHEN share > 0.8 THEN format END AS format, share FROM shares ORDER BY share DESC, format_rank LIMIT 1""",
      lambda s, d: conform.detect_date_format(raw_sales(s, d), "trx_date"))
R.add("c9_standardize_dates", "row_id:i, trx_date", f"WITH {RAW_SQL} SELECT row_id, CAST(try_strptime(trx_date, '%d/%m/%Y') AS DATE) AS trx_date FROM raw",
      lambda s, d: conform.standardize_dates(raw_sales(s, d), "trx_date"))
R.add("c9_standardize_mixed", "row_id:i, order_date", f"{MIXED_SQL} SELECT row_id, {parse_sql('order_date')} AS order_date FROM mixed",
      lambda s, d: conform.standardize_dates(_mixed(s, d), "order_date"))
R.add("c10_period_label", "date, day, week, month, quarter, year", f"""{PART}, days AS (SELECT DISTINCT date FROM demand)
    SELECT date, strftime(date, '%Y-%m-%d') AS day, 'Week ' || weekofyear(date) || ', ' || year(date) AS week,
           strftime(date, '%B %Y') AS month, 'Q' || quarter(date) || ' ' || year(date) AS quarter, CAST(year(date) AS VARCHAR) AS year FROM days""",
      lambda s, d: demand(s, d).select("date").distinct().select(
          "date", *[period_label(F.col("date"), p).alias(p) for p in ("day", "week", "month", "quarter", "year")]))
R.add("c11_strip_times", "o_orderkey:i, o_orderdate, shipped", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
    strftime(o_orderdate, '%Y-%m-%d') AS shipped FROM orders""",
      lambda s, d: conform.strip_times(table(s, d, "orders")).withColumn("shipped", date_text(F.concat("o_orderdate", F.lit("T12:00:00")))))
R.add("c12_display", "l_orderkey:i, l_partkey:i, l_suppkey:i, l_linenumber:i, l_quantity:d, l_extendedprice:d, l_discount:d, l_tax:d, l_returnflag, l_linestatus",
      "SELECT * FROM lineitem", lambda s, d: conform.display(table(s, d, "lineitem")))
R.add("c13_finite_or_zero", "event_id:i, y:d", """SELECT event_id, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0.0 ELSE v END AS y FROM (
    SELECT event_id, TRY_CAST(CASE event_id % 4 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN event_type
        ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v FROM events)""",
      lambda s, d: table(s, d, "events").select("event_id", conform.finite_or_zero(F.expr(
          "case event_id % 4 when 0 then 'NaN' when 1 then 'Infinity' when 2 then event_type else cast(value as string) end")).alias("y")))

