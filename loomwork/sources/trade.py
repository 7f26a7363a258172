"""The star schema as a property graph: what supplies an order, who ordered it, and where.

Suppliers and parts are sources, orders staging models, customers intermediate
ones, nations marts, and regions exposures. Every table is derived by joins and
projections of the given ones, so a graph has as many edges as there are line items.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.session import table


def named(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


SUPPLIER, PART, ORDER, CUSTOMER, NATION, REGION = "source.trade.s", "source.trade.p", "model.trade.o", "model.trade.c", "model.trade.n", "exposure.trade.r"


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def some(name: str, prefix: str, key: str, title: Column, label: str, layer: str | None, materialized: Column, sql: Column, priority: Column, kind: str | None) -> DataFrame:
        return table(spark, sf_dir, name).select(
            named(prefix, key).alias("unique_id"), title.alias("name"), F.lit(label).alias("label"), F.lit(layer).cast("string").alias("layer"), materialized.cast("string").alias("materialized"),
            F.lit("").alias("description"), F.lit(None).cast("long").alias("row_count"), priority.cast("string").alias("priority"), F.lit("high" if kind else None).cast("string").alias("maturity"),
            F.lit(kind).cast("string").alias("exposure_type"), sql.cast("string").alias("sql"))

    none = F.lit(None)
    status = F.col("o_orderstatus")
    return _union(
        some("supplier", SUPPLIER, "s_suppkey", F.col("s_name"), "Source", None, none, none, none, None),
        some("part", PART, "p_partkey", F.col("p_name"), "Source", None, none, none, none, None),
        some("orders", ORDER, "o_orderkey", named("order ", "o_orderkey"), "Model", "staging", F.when(status == "F", "view").when(status == "O", "table").otherwise("incremental"),
             F.when(F.col("o_orderkey") % 3 > 0, named("select total from o", "o_orderkey")), none, None),
        some("customer", CUSTOMER, "c_custkey", F.col("c_name"), "Model", "intermediate", F.when(F.col("c_acctbal") > 0, "table").otherwise("view"), none, none, None),
        some("nation", NATION, "n_nationkey", F.col("n_name"), "Model", "marts", F.lit("table"), none, none, None),
        some("region", REGION, "r_regionkey", F.col("r_name"), "Exposure", None, none, none, F.when(F.col("r_regionkey") % 2 == 0, "high").otherwise("medium"), "dashboard"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def some(name: str, up: Column, down: Column, kind: str) -> DataFrame:
        return table(spark, sf_dir, name).select(up.alias("source_id"), down.alias("target_id"), F.lit(kind).alias("edge_type"))

    return _union(
        some("lineitem", named(SUPPLIER, "l_suppkey"), named(ORDER, "l_orderkey"), "source"), some("lineitem", named(PART, "l_partkey"), named(ORDER, "l_orderkey"), "source"),
        some("orders", named(ORDER, "o_orderkey"), named(CUSTOMER, "o_custkey"), "ref"), some("customer", named(CUSTOMER, "c_custkey"), named(NATION, "c_nationkey"), "ref"),
        some("nation", named(NATION, "n_nationkey"), named(REGION, "n_regionkey"), "consumes")).distinct()


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test of each urgent order's total, two of each customer's balance in one segment, a custom test of each nation."""
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(
        named("test.trade.not_null_o", "o_orderkey").alias("test_id"), named(ORDER, "o_orderkey").alias("target_id"), F.lit("total").alias("column_name"), F.lit("not_null").alias("test_type"))
    kinds = F.explode(F.array(F.lit("unique"), F.lit("not_null")))
    segment = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", kinds.alias("test_type")).select(
        F.concat(F.lit("test.trade."), "test_type", F.lit("_c"), F.col("c_custkey").cast("string")).alias("test_id"), named(CUSTOMER, "c_custkey").alias("target_id"), F.lit("balance").alias("column_name"), "test_type")
    nation = table(spark, sf_dir, "nation").select(named("test.trade.assert_n", "n_nationkey").alias("test_id"), named(NATION, "n_nationkey").alias("target_id"), F.lit(None).cast("string").alias("column_name"), F.lit("custom").alias("test_type"))
    return _union(urgent, segment, nation)


#: The columns of each kind of node, by table and key.
OWNED = {"supplier": (SUPPLIER, "s_suppkey", ("balance", "name")), "part": (PART, "p_partkey", ("price", "name")), "orders": (ORDER, "o_orderkey", ("total", "status", "day")),
         "customer": (CUSTOMER, "c_custkey", ("balance", "segment")), "nation": (NATION, "n_nationkey", ("balance", "name"))}


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, (prefix, key, owned) in OWNED.items():
        node = table(spark, sf_dir, name).select(named(prefix, key).alias("node_id"), F.explode(F.array(*map(F.lit, owned))).alias("column_name"))
        kind = F.when(F.col("column_name").isin("balance", "price", "total"), "double").otherwise("string")
        parts.append(node.select(F.concat_ws(".", "node_id", "column_name").alias("column_id"), "node_id", "column_name", kind.alias("data_type")))
    return _union(*parts)


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column edges whose confidence comes from the rows: discounts lower it, and so do the priority of an order and a debt."""
    def some(df: DataFrame, up: Column, up_column: str, down: Column, down_column: str, confidence: Column) -> DataFrame:
        return df.select(up.alias("up_node"), F.lit(up_column).alias("up_column"), down.alias("down_node"), F.lit(down_column).alias("down_column"), confidence.cast("double").alias("confidence"))

    items, orders, customers = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    order, customer = named(ORDER, "l_orderkey"), named(CUSTOMER, "o_custkey")
    return _union(
        some(items.filter("l_returnflag <> 'A'"), named(SUPPLIER, "l_suppkey"), "balance", order, "total", 1 - F.col("l_discount")),
        some(items, named(PART, "l_partkey"), "price", order, "total", 1 - F.col("l_tax")),
        some(orders.filter("o_orderstatus <> 'P'"), named(ORDER, "o_orderkey"), "total", customer, "balance", 1 - F.substring("o_orderpriority", 1, 1).cast("int") / 20),
        some(customers.filter("c_acctbal > -500"), named(CUSTOMER, "c_custkey"), "balance", named(NATION, "c_nationkey"), "balance", F.when(F.col("c_acctbal") > 0, 0.9).otherwise(0.6)))


def graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four graph tables."""
    return {"graph_nodes": nodes(spark, sf_dir), "graph_edges": edges(spark, sf_dir), "graph_tests": tests(spark, sf_dir), "graph_columns": columns(spark, sf_dir)}


def events(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...], severities: tuple[str, ...]) -> DataFrame:
    """An anomaly at every supplier: of its balance, of a column that does not exist, or of the whole; some at a test or a node that is unknown."""
    key = F.col("s_suppkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))
    node = F.when(key % 10 == 9, named("source.trade.gone", "s_suppkey")).when(key % 10 == 8, F.concat(F.lit("test.trade.assert_n"), (key % 25).cast("string"))).otherwise(named(SUPPLIER, "s_suppkey"))
    column = F.when(key % 10 < 8, F.when(key % 3 == 0, "balance").when(key % 3 == 1, "no_such"))
    return table(spark, sf_dir, "supplier").select(key.alias("event_id"), node.alias("node_id"), column.alias("column_name"), pick(kinds).alias("event_type"), pick(severities).alias("severity"))
