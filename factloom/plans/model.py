"""The typed graph as views over the supplied tables, and the same views in SQL.

Mapping: customer = deal, orders = provision (rp, di, mfn by status), lineitem =
extracted basket entity, part brand = concrete type, part type = abstract type,
events = answers, documents = agreement texts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stand-ins of named types.
BUILDER, RATIO, INCREMENTAL, PERMITTED = "Brand#11", "PROMO", "ECONOMY", "STANDARD"
EBITDA = 250_000_000

#: Common table expressions that mirror the views of ``Graph``.
SQL = {
    "b": """SELECT l_orderkey AS provision_id, concat_ws('_', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS entity_id,
  p_brand AS type_name, p_type AS super_type, p_name AS label, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS cap,
  l_discount > 0.05 AS is_grower, CAST(l_tax * 100 AS DECIMAL(18,2)) AS pct,
  CASE WHEN p_size <= 12 THEN 'general_purpose' WHEN p_size <= 25 THEN 'ratio' WHEN p_size <= 38 THEN 'fixed' ELSE 'other' END AS category,
  l_suppkey AS suppkey, l_partkey AS partkey, l_linenumber AS line, l_quantity AS qty, l_linestatus AS status, l_shipdate AS shipdate
  FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "p": """SELECT o_orderkey AS provision_id, o_custkey AS deal_id, CASE o_orderstatus WHEN 'F' THEN 'rp' WHEN 'O' THEN 'di' ELSE 'mfn' END AS ptype,
  o_totalprice AS total, o_orderdate AS created, o_orderpriority AS priority FROM orders""",
    "d": "SELECT c_custkey AS deal_id, c_name AS deal_name, c_nationkey AS nation, c_mktsegment AS segment, c_acctbal AS balance FROM customer",
    "a": """SELECT event_id AS answer_id, user_id AS provision_id, event_type AS answer_type, concat(event_type, '_', CAST(event_id % 40 AS VARCHAR)) AS question_id,
  value AS number, props, ts AS extracted_at, CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'not_found' END AS confidence FROM events""",
}


def with_views(names: str, sql: str) -> str:
    """SQL with the named views put before it; further CTEs of the query follow after a comma."""
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
    body = sql.strip()
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"


class Graph:
    """Lazy views over one data folder; nothing is cached or collected."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def baskets(self) -> DataFrame:
        money = lambda c: F.col(c).cast("decimal(18,2)")
        size = F.col("p_size")
        return self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_orderkey").alias("provision_id"),
            F.concat_ws("_", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("entity_id"),
            F.col("p_brand").alias("type_name"),
            F.col("p_type").alias("super_type"),
            F.col("p_name").alias("label"),
            money("l_extendedprice").alias("amount"),
            F.when(F.col("l_returnflag") != "R", money("l_extendedprice")).alias("cap"),
            (F.col("l_discount") > 0.05).alias("is_grower"),
            (F.col("l_tax") * 100).cast("decimal(18,2)").alias("pct"),
            F.when(size <= 12, "general_purpose").when(size <= 25, "ratio").when(size <= 38, "fixed").otherwise("other").alias("category"),
            F.col("l_suppkey").alias("suppkey"),
            F.col("l_partkey").alias("partkey"),
            F.col("l_linenumber").alias("line"),
            F.col("l_quantity").alias("qty"),
            F.col("l_linestatus").alias("status"),
            F.col("l_shipdate").alias("shipdate"),
        )

    @cached_property
    def provisions(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.table("orders").select(
            F.col("o_orderkey").alias("provision_id"),
            F.col("o_custkey").alias("deal_id"),
            F.when(status == "F", "rp").when(status == "O", "di").otherwise("mfn").alias("ptype"),
            F.col("o_totalprice").alias("total"),
            F.col("o_orderdate").alias("created"),
            F.col("o_orderpriority").alias("priority"),
        )

    def provisions_of(self, ptype: str) -> DataFrame:
        # The status filter, not the derived type, reaches the scan.
        status = {"rp": "F", "di": "O", "mfn": "P"}[ptype]
        return self.table("orders").filter(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("provision_id"), F.col("o_custkey").alias("deal_id"))

    @cached_property
    def deals(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("deal_id"), F.col("c_name").alias("deal_name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))

    @cached_property
    def answers(self) -> DataFrame:
        k = F.col("event_id") % 4
        return self.table("events").select(
            F.col("event_id").alias("answer_id"),
            F.col("user_id").alias("provision_id"),
            F.col("event_type").alias("answer_type"),
            F.concat("event_type", F.lit("_"), (F.col("event_id") % 40).cast("string")).alias("question_id"),
            F.col("value").alias("number"),
            "props",
            F.col("ts").alias("extracted_at"),
            F.when(k == 0, "low").when(k == 1, "high").when(k == 2, "medium").otherwise("not_found").alias("confidence"),
        )

    def sub(self) -> DataFrame:
        """(sub, super): brand under type, type under 'basket'."""
        part = self.table("part")
        leaf = part.select(F.concat_ws("/", "p_type", "p_brand").alias("sub"), F.col("p_type").alias("super")).distinct()
        return leaf.unionByName(part.select(F.col("p_type").alias("sub"), F.lit("basket").alias("super")).distinct())


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable:
    """Registers ``f(graph)`` under ``name`` with its SQL."""

    def register(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_views(views, sql) if views else sql
        return f

    return register


def dollars(c: str, name: str):
    """Sum of a decimal column as a double."""
    return F.sum(c).cast("double").alias(name)
