"""Queries over tables that are kept up to date in steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators.upsertlog import UpsertLog
from quillframe.plans.registry import query, table
from quillframe.sources.store import scratch


@query("""
WITH o AS (SELECT o_orderkey, o_orderstatus, CAST(o_custkey AS BIGINT) AS owner, 0 AS version, 0 AS batch, false AS gone FROM orders),
steps AS (SELECT unnest(range(1, 10)) AS k),
later AS (
  SELECT o_orderkey, chr(CAST(64 + k AS INTEGER)), owner + k, CASE WHEN o_orderkey % 5 = 0 THEN k - 3 ELSE k END, k, k = 8 AND o_orderkey % 4 = 1 FROM o, steps WHERE (o_orderkey + k) % 7 = 0
  UNION ALL SELECT o_orderkey + 100000000, 'N', owner, k, k, false FROM o, steps WHERE o_orderkey % 10 = k),
a AS (SELECT * FROM o UNION ALL SELECT * FROM later),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY version DESC, batch DESC) AS r, first_value(owner) OVER (PARTITION BY o_orderkey ORDER BY version, batch) AS first_owner FROM a)
SELECT o_orderkey, o_orderstatus, first_owner AS owner, CAST(version AS INTEGER) AS version FROM r WHERE r = 1 AND NOT gone""")
def logged_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after ten batches of upserts and deletes, some of them late, with small steps merged in between; each order keeps its first owner."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").cast("long").alias("owner"), F.lit(0).alias("version"))
    log = UpsertLog.create(spark, f"{scratch(spark)}/upserts-{uuid.uuid4().hex}", orders.schema, ["o_orderkey"], "version", keep_first=("owner",))
    log.append(orders, 0)
    for k in range(1, 10):
        known = orders.where((F.col("o_orderkey") + k) % 7 == 0)
        late = F.when(F.col("o_orderkey") % 5 == 0, k - 3).otherwise(k)
        known = known.withColumns({"o_orderstatus": F.lit(chr(64 + k)), "owner": F.col("owner") + k, "version": late})
        fresh = orders.where(F.col("o_orderkey") % 10 == k).withColumns({"o_orderkey": F.col("o_orderkey") + 100_000_000, "o_orderstatus": F.lit("N"), "version": F.lit(k)})
        gone = F.col("o_orderkey") % 4 == 1 if k == 8 else None
        log.append(known.unionByName(fresh), k, gone & (F.col("o_orderstatus") != "N") if k == 8 else None)
        if k % 3 == 0:
            log.compact()
    return log.read()
