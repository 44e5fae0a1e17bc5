"""Operators on hot items, with bounds so small that every hot item is cut (A, F, W).

One item and the null item hold a third of the rows each; half of theirs are on one day, some
rows have no date, and row ids clump by split number as those of ``with_row_id`` do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallycast.config import SkewConfig
from tallycast.operators import anomaly, clean, features
from tallycast.plans.anomaly_queries import IQR_SQL, RECORD, RETURNS, ROLLING, ZEROS_SQL
from tallycast.plans.data import DIRTY, PROMO, Register, table
from tallycast.plans.feature_queries import ALL_20, KEY, features_sql, spec

R = Register()
SMALL = SkewConfig(hot_rows=500)
HOT = {
    "row_id": "(l_orderkey % 11) * 8589934592 + (l_orderkey * 1000003 + l_linenumber * 7919 + l_partkey * 104729 + l_suppkey * 15485863 + cast(l_quantity as bigint) * 32452843) % 8589934592",
    "date": """case when l_orderkey % 13 = 0 then cast(null as date)
               when l_linenumber % 2 = 0 and l_orderkey % 3 < 2 then date '1998-03-05' else cast(l_shipdate as date) end""",
    "price": "l_extendedprice / l_quantity",
    "promo": PROMO,
}


def _hot(spark, folder, quantity: str = "l_quantity") -> DataFrame:
    expressions = [f"{text} as {name}" for name, text in HOT.items()]
    return table(spark, folder, "lineitem").selectExpr(
        *expressions, f"{quantity} as quantity", "cast(null as string) as category",
        "case l_orderkey % 3 when 0 then 'hot' when 2 then cast(l_partkey as string) end as sku")


def _hot_sql(quantity: str = "l_quantity") -> str:
    expressions = ", ".join(f"{text} AS {name}" for name, text in HOT.items())
    return f"""demand AS (SELECT {expressions}, {quantity} AS quantity, CAST(NULL AS VARCHAR) AS category,
        CASE l_orderkey % 3 WHEN 0 THEN 'hot' WHEN 2 THEN CAST(l_partkey AS VARCHAR) END AS sku FROM lineitem)"""


ORDER = "PARTITION BY sku ORDER BY date NULLS FIRST, row_id"
for _way, _value in (("forward", f"last_value(quantity IGNORE NULLS) OVER ({ORDER} ROWS UNBOUNDED PRECEDING)"),
                     ("backward", f"first_value(quantity IGNORE NULLS) OVER ({ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")):
    R.add(f"f1_split_{_way}", "sku, date, row_id:i, quantity:d", f"WITH {_hot_sql(DIRTY)} SELECT sku, date, row_id, {_value} AS quantity FROM demand",
          lambda s, d, w=_way: clean.fill_neighbour(_hot(s, d, DIRTY), ["quantity"], w == "forward", SMALL))
R.add("a1_split", RECORD, f"WITH {_hot_sql(RETURNS)}, {IQR_SQL} SELECT * FROM anomalies",
      lambda s, d: anomaly.detect_iqr(_hot(s, d, RETURNS), skew=SMALL))
R.add("a3_split", RECORD, f"""WITH {_hot_sql()}, r AS (SELECT *, avg(quantity) OVER w AS m, stddev_samp(quantity) OVER w AS sd, count(quantity) OVER w AS k,
        count(*) OVER (PARTITION BY sku) AS n FROM demand WINDOW w AS ({ORDER} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
    SELECT sku, date, quantity AS value, m AS expected_value, CASE WHEN quantity > m THEN 'spike' ELSE 'drop' END AS anomaly_type,
        least(1.0, abs(quantity - m) / sd / 4) AS severity, 'rolling' AS method FROM r WHERE k = 7 AND n >= 8 AND sd > 0 AND abs(quantity - m) / sd > 2""",
      lambda s, d: anomaly.detect_rolling(_hot(s, d), ROLLING, SMALL))
MOSTLY_ZERO = "case when l_quantity < 40 then 0 else l_quantity end"
R.add("a4_split", RECORD, f"""WITH {_hot_sql(MOSTLY_ZERO)}, {ZEROS_SQL.replace("CASE WHEN date < DATE '1999-01-01' THEN 0 ELSE quantity END", "quantity").replace(
        "ORDER BY date, row_id", "ORDER BY date NULLS FIRST, row_id")} SELECT * FROM zeros WHERE sku IS NOT NULL""",
      lambda s, d: anomaly.detect_zeros(_hot(s, d, MOSTLY_ZERO), skew=SMALL))
R.add("w15_split", f"{KEY}, {spec(ALL_20)}",
      "WITH " + features_sql(_hot_sql()).replace("ORDER BY date, row_id", "ORDER BY date NULLS FIRST, row_id") + " SELECT * FROM featured",
      lambda s, d: features.create_features(_hot(s, d), "all_20", SMALL))
