"""Views over the driver's tables that stand for the panel's tables: SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "bars": """SELECT concat('S', CAST(l_suppkey AS STRING)) AS ticker, CAST(l_shipdate AS DATE) AS date,
       min(l_extendedprice) AS open, max(l_extendedprice) AS close,
       max(l_extendedprice) * (1 - min(l_discount)) AS adj_close,
       sum(l_quantity) AS volume, max(l_extendedprice) * sum(l_quantity) AS dollar_volume
FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "valuations": """SELECT concat('S', CAST(l_suppkey AS STRING)) AS ticker, CAST(l_shipdate AS DATE) AS date,
       1e3 + (l_suppkey % 37) * 10 + sum(l_quantity) AS marketcap,
       max(l_quantity) - 5 * sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS pe,
       min(l_quantity) / 10 AS pb, max(l_linenumber) / 2e0 AS ps, max(l_quantity) / 3 AS evebitda
FROM lineitem WHERE l_suppkey % 11 <> 0 GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "filings": """SELECT concat('S', CAST(l_suppkey AS STRING)) AS ticker,
       CAST(CAST(max(l_shipdate) AS DATE) + INTERVAL 40 DAY AS DATE) AS date,
       'ART' AS dimension, max(l_tax) AS roe, min(l_tax) AS divyield, min(l_discount) + 5e-1 AS de,
       1 + count(*) / 1e1 AS currentratio, sum(l_quantity) * 1000 AS fcf
FROM lineitem GROUP BY l_suppkey, date_trunc('quarter', l_shipdate)""",
    "index_events": """SELECT DATE '1995-01-01' AS date, concat('S', CAST(s_suppkey AS STRING)) AS ticker, 'historical' AS action
FROM supplier WHERE s_suppkey % 3 <> 0
UNION ALL SELECT CAST(DATE '1996-01-01' + (s_suppkey % 300) * INTERVAL '1' DAY AS DATE), concat('S', CAST(s_suppkey AS STRING)), 'removed'
FROM supplier WHERE s_suppkey % 5 = 1
UNION ALL SELECT CAST(DATE '1997-01-01' + (s_suppkey % 300) * INTERVAL '1' DAY AS DATE), concat('S', CAST(s_suppkey AS STRING)), 'added'
FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT DATE '1999-01-04', concat('S', CAST(s_suppkey AS STRING)), 'historical' FROM supplier WHERE s_suppkey % 4 <> 0
UNION ALL SELECT DATE '2000-01-03', concat('S', CAST(s_suppkey AS STRING)), 'removed' FROM supplier WHERE s_suppkey % 7 = 0
UNION ALL SELECT DATE '2000-01-03', concat('S', CAST(s_suppkey AS STRING)), 'added' FROM supplier WHERE s_suppkey % 14 = 0""",
    "bench_px": """SELECT 'B' AS series_id, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS close
FROM lineitem WHERE extract(day FROM l_shipdate) % 4 <> 0 GROUP BY CAST(l_shipdate AS DATE)""",
    "equity": """SELECT concat(l_returnflag, l_linestatus) AS strategy, CAST(l_shipdate AS DATE) AS date,
       2e4 + sum(l_quantity) AS equity
FROM lineitem GROUP BY l_returnflag, l_linestatus, CAST(l_shipdate AS DATE)""",
    "candidates": """SELECT p_partkey AS candidate_id, ((p_partkey * 7919 + 1 * 104729) % 1000) / 1e3 AS w1,
       ((p_partkey * 7919 + 2 * 104729) % 1000) / 1e3 - 2e-1 AS w2,
       ((p_partkey * 7919 + 3 * 104729) % 1000) / 1e3 AS w3
FROM part""",
    "instruments": """SELECT concat('s', CAST(s_suppkey AS STRING), '_US_EQ') AS broker_ticker,
       concat('S', CAST(CASE WHEN s_suppkey % 10 = 0 THEN s_suppkey - 1 ELSE s_suppkey END AS STRING)) AS short_name,
       CASE WHEN s_suppkey % 9 = 0 THEN 'ETF' ELSE 'STOCK' END AS type,
       CASE WHEN s_suppkey % 8 = 0 THEN 'EUR' ELSE 'USD' END AS currency_code,
       concat('ISIN', CAST(s_suppkey AS STRING)) AS isin
FROM supplier""",
}


class Tables:
    """The driver's tables and the views over them, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            text = re.sub(r"\b(FROM) (lineitem|supplier|part)\b", r"\1 {\2}", VIEWS[name])
            used = set(re.findall(r"\{(\w+)\}", text))
            found = self.spark.sql(text, **{t: getattr(self, t) for t in used})
        elif name.startswith("_"):
            raise AttributeError(name)
        else:
            found = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        setattr(self, name, found)
        return found
