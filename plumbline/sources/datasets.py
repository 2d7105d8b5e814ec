"""Tables and derived datasets.  Each dataset is one SQL text that reads the same in Spark and in other engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_YEARS = ", ".join(f"({y})" for y in range(1995, 2002))

SQL = {
    # customer x year: outcome, cohort (0 = never treated), treatment, cluster, covariate
    "panel": f"""SELECT c.c_custkey AS id, v.t AS t, coalesce(o.y, CAST(0 AS DOUBLE)) / 100000 AS y,
        CASE WHEN c.c_custkey % 5 = 0 THEN 0 ELSE 1995 + c.c_custkey % 5 END AS g,
        CASE WHEN c.c_custkey % 5 > 0 AND v.t >= 1995 + c.c_custkey % 5 THEN 1 ELSE 0 END AS treat,
        c.c_nationkey AS cluster, c.c_acctbal / 1000 AS x, c.c_mktsegment AS segment
        FROM {{customer}} c CROSS JOIN (VALUES {_YEARS}) v(t)
        LEFT JOIN (SELECT o_custkey, year(o_orderdate) AS t, sum(o_totalprice) AS y FROM {{orders}} GROUP BY o_custkey, year(o_orderdate)) o
        ON o.o_custkey = c.c_custkey AND o.t = v.t""",
    # nation x nation in the same region, rows sum to one
    "edges": """SELECT a.n_nationkey AS src, b.n_nationkey AS dst, CAST(1 AS DOUBLE) / (s.n - 1) AS w
        FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey
        JOIN (SELECT n_regionkey, count(*) AS n FROM {nation} GROUP BY n_regionkey) s ON s.n_regionkey = a.n_regionkey""",
    "nations": """SELECT c_nationkey AS id, avg(c_acctbal) / 1000 AS x, avg(o.spent) / 100000 AS y FROM {customer}
        JOIN (SELECT o_custkey, sum(o_totalprice) AS spent FROM {orders} GROUP BY o_custkey) o ON o.o_custkey = c_custkey GROUP BY c_nationkey""",
    "ivset": """SELECT l_extendedprice / 10000 AS y, l_quantity / 10 AS x, p_retailprice / 1000 AS z1, CAST(p_size AS DOUBLE) / 10 AS z2,
        l_discount * 10 AS w, l_suppkey AS cluster FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""",
    "rct": """SELECT c_custkey AS id, c_acctbal / 1000 AS y, CASE WHEN substr(md5(CAST(c_custkey AS STRING)), 1, 1) < '8' THEN 1 ELSE 0 END AS arm,
        c_mktsegment AS stratum, CAST(c_nationkey AS DOUBLE) / 10 AS x, c_nationkey AS nation FROM {customer}""",
    "gappy": """SELECT l_orderkey AS id, l_linenumber AS t, sum(l_quantity) AS v FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "lines": """SELECT l_extendedprice / 10000 AS y, l_quantity / 10 AS q, l_discount * 10 AS d, l_tax * 10 AS x, l_suppkey AS supp, l_partkey AS part,
        l_returnflag AS flag, l_linestatus AS status FROM {lineitem}""",
    "spend": """SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal / 1000 AS x, n_regionkey AS region, c_mktsegment AS segment,
        coalesce(o.y, CAST(0 AS DOUBLE)) / 100000 AS y FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey
        LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS y FROM {orders} GROUP BY o_custkey) o ON o.o_custkey = c_custkey""",
    # customers' years with orders: a panel with gaps
    "ordered": """SELECT o_custkey AS id, year(o_orderdate) AS t, sum(o_totalprice) / 100000 AS y, CAST(count(*) AS DOUBLE) AS x FROM {orders} GROUP BY o_custkey, year(o_orderdate)""",
    "monthly": """SELECT o_orderpriority AS s, year(o_orderdate) * 12 + month(o_orderdate) AS t, sum(o_totalprice) / 1000000 AS y,
        CAST(count(*) AS DOUBLE) / 100 AS x FROM {orders} GROUP BY o_orderpriority, year(o_orderdate) * 12 + month(o_orderdate)""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dataset(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = SQL[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def text(name: str) -> str:
    """The dataset's SQL over plain table names."""
    return SQL[name].format(**{t: t for t in TABLES}).replace("AS STRING", "AS VARCHAR")
