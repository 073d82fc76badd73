"""Logical views over the supplied tables, once as DataFrames and once as SQL for the checks.

Transactions come from orders and customers, fine-grained transactions and findings from lineitem, metrics, prices and
activity from events, chains from nations and regions, merchants from customers, sources from documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.tables import table


class Views:
    """The logical views of one data folder; each is read lazily and only its used columns reach the scan."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @property
    def transactions(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").otherwise("pending")
        joined = self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return joined.select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("merchant_id"), F.col("c_nationkey").alias("chain_id"),
            F.col("o_totalprice").alias("gas_used"), (F.col("o_totalprice") * 0.01).alias("fee"), status.alias("status"),
            F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"),
            F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("reverted: "), F.col("o_orderpriority"))).alias("error"),
        )

    @property
    def tx_lines(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("merchant_id"),
            (F.col("l_quantity") * 1000).alias("gas_used"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("gas_price"),
            F.col("l_returnflag").alias("type"), F.when(F.col("l_linestatus") == "F", "success").otherwise("failed").alias("status"),
            F.col("l_shipdate").alias("ts"),
        )

    @property
    def merchants(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("plan"),
            F.col("c_nationkey").alias("country"), F.col("c_acctbal").alias("balance"),
        )

    @property
    def chains(self) -> DataFrame:
        return self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").alias("chain_id"), F.col("n_name").alias("name"), F.col("r_name").alias("network")
        )

    @property
    def savings(self) -> DataFrame:
        return self.raw("lineitem").join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_suppkey").alias("project_id"), F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("line"),
            F.col("p_brand").alias("file"), F.col("p_type").alias("rule_id"), F.col("l_quantity").cast("long").alias("gas_saved"),
            (F.col("l_linenumber") % 4 + 1).alias("severity"), F.col("l_shipdate").alias("created_at"),
        )

    @property
    def metrics(self) -> DataFrame:
        return self.raw("events").select(
            "event_id", F.col("event_type").alias("endpoint"), F.col("value").alias("response_time"),
            F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"), "ts", "user_id",
        )

    @property
    def prices(self) -> DataFrame:
        priority = F.get_json_object("props", "$.k").cast("double")
        return self.raw("events").select("event_id", F.col("user_id").alias("chain_id"), F.col("value").alias("base_fee"), priority.alias("priority_fee"), "ts")

    @property
    def findings(self) -> DataFrame:
        level = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("l_linenumber") % 5 + 1)
        return self.raw("lineitem").join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey")).select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("p_type").alias("rule_id"), F.col("p_brand").alias("file"),
            (F.col("l_partkey") % 50).alias("line_no"), level.alias("severity"), F.lower("p_name").alias("message"),
            F.col("l_discount").alias("confidence"), F.col("l_quantity").cast("long").alias("savings"), F.col("l_suppkey").alias("project_id"),
            F.col("l_orderkey").alias("scan_id"), F.date_trunc("month", "l_shipdate").alias("month"),
        )

    @property
    def sources(self) -> DataFrame:
        return self.raw("documents").select(F.col("doc_id").alias("file"), F.col("text").alias("source"), "lang", F.col("source").alias("origin"))


#: Severities from lowest to highest.
SEVERITIES = ["info", "low", "medium", "high", "critical"]

#: The same views in SQL.
SQL = {
    "transactions": """select o_orderkey as id, o_custkey as merchant_id, c_nationkey as chain_id, o_totalprice as gas_used,
  o_totalprice * 0.01 as fee, case o_orderstatus when 'F' then 'success' when 'O' then 'failed' else 'pending' end as status,
  o_orderpriority as priority, o_orderdate as created_at,
  case when o_orderstatus = 'O' then 'reverted: ' || o_orderpriority end as error
  from orders join customer on o_custkey = c_custkey""",
    "tx_lines": """select l_orderkey as id, l_linenumber as line, l_suppkey as merchant_id, l_quantity * 1000 as gas_used,
  l_extendedprice / l_quantity as gas_price, l_returnflag as type,
  case l_linestatus when 'F' then 'success' else 'failed' end as status, l_shipdate as ts from lineitem""",
    "merchants": "select c_custkey as id, c_name as name, c_mktsegment as plan, c_nationkey as country, c_acctbal as balance from customer",
    "chains": "select n_nationkey as chain_id, n_name as name, r_name as network from nation join region on n_regionkey = r_regionkey",
    "savings": """select l_suppkey as project_id, l_orderkey as scan_id, l_linenumber as line, p_brand as file, p_type as rule_id,
  cast(l_quantity as bigint) as gas_saved, l_linenumber % 4 + 1 as severity, l_shipdate as created_at
  from lineitem join part on l_partkey = p_partkey""",
    "metrics": """select event_id, event_type as endpoint, value as response_time,
  case when event_type = 'error' then 500 else 200 end as status_code, ts, user_id from events""",
    "prices": """select event_id, user_id as chain_id, value as base_fee, cast(json_extract_string(props, '$.k') as double) as priority_fee, ts
  from events""",
    "findings": """select l_orderkey || '-' || l_linenumber as id, p_type as rule_id, p_brand as file, l_partkey % 50 as line_no,
  ['info', 'low', 'medium', 'high', 'critical'][l_linenumber % 5 + 1] as severity, lower(p_name) as message, l_discount as confidence,
  cast(l_quantity as bigint) as savings, l_suppkey as project_id, l_orderkey as scan_id, date_trunc('month', l_shipdate) as month
  from lineitem join part on l_partkey = p_partkey""",
    "sources": "select doc_id as file, text as source, lang, source as origin from documents",
}


def over(views: str, body: str) -> str:
    """SQL of ``body`` with the named views (blank-separated) as common table expressions in front."""
    body = body.strip()
    ctes = ", ".join(f"{name} as ({SQL[name]})" for name in views.split())
    if body[:5].lower() == "with ":
        return f"with {ctes}, {body[5:]}"
    return f"with {ctes} {body}"
