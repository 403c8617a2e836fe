"""Views of the driver tables in the shapes that the operators take, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark, df: DataFrame) -> DataFrame:
    """Rows of a table dealt out evenly, before files are made of them: a small table is one partition, and its files would be parsed by one task."""
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), df.columns[0])


def files(spark, sf_dir) -> DataFrame:
    """documents as files: path source/lang/id, content."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


FILES = "(SELECT source || '/' || lang || '/' || doc_id AS path, text AS content FROM documents)"


def lines_sql(source: str, path: str = "path", content: str = "content") -> str:
    return f"""(SELECT {path} AS path, CAST(unnest(range(1, len(parts) + 1)) AS INTEGER) AS line, unnest(parts) AS text
      FROM (SELECT {path}, string_split(regexp_replace({content}, '\\n$', ''), chr(10)) AS parts FROM {source}))"""


LINES = lines_sql(FILES)


def part_docs(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("path"), F.col("p_brand").alias("superclass"))


def trade_edges(spark, sf_dir) -> DataFrame:
    """For each nation the two others it buys from at the highest single price: (src, dst) names."""
    c, o, li, s, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "supplier", "nation"))
    pairs = o.join(c, o["o_custkey"] == c["c_custkey"]).join(li, o["o_orderkey"] == li["l_orderkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])
    pairs = pairs.where("c_nationkey != s_nationkey").groupBy("c_nationkey", "s_nationkey").agg(F.max("l_extendedprice").alias("top"))
    best = Window.partitionBy("c_nationkey").orderBy(F.desc("top"), "s_nationkey")
    pairs = pairs.withColumn("r", F.row_number().over(best)).where("r <= 2")
    a, b = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("src")), n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("dst"))
    return pairs.join(F.broadcast(a), "c_nationkey").join(F.broadcast(b), "s_nationkey").select("src", "dst")


TRADE = """trade AS (SELECT a.n_name AS src, b.n_name AS dst FROM (
      SELECT c_nationkey, s_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY max(l_extendedprice) DESC, s_nationkey) AS r
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
      WHERE c_nationkey <> s_nationkey GROUP BY c_nationkey, s_nationkey) t
    JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey WHERE r <= 2)"""
