"""The as-of join on events, which are not part of what documents hold but exercise the operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import relate
from quire.plans.registry import query
from quire.sources.tables import table

_KINDS = "(SELECT min(event_type) AS a, max(event_type) AS b FROM events)"


@query(f"""
SELECT l.event_id, (SELECT max(r.ts) FROM events r WHERE r.user_id = l.user_id AND r.ts < l.ts AND r.event_type = k.a) AS last_ts
FROM events l, {_KINDS} k WHERE l.event_type = k.b
AND EXISTS (SELECT 1 FROM events r WHERE r.user_id = l.user_id AND r.ts < l.ts AND r.event_type = k.a)
""")
def j2_asof(spark: SparkSession, folder: str) -> DataFrame:
    """For events of one kind the time of the user's last event of another kind before."""
    events = table(spark, folder, "events")
    kinds = events.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    left = events.where(F.col("event_type") == kinds["b"]).select("event_id", "user_id", "ts")
    right = events.where(F.col("event_type") == kinds["a"]).select("user_id", "ts", F.col("ts").alias("last_ts"))
    return relate.asof_join(left, right, on="ts", by=["user_id"], values=["last_ts"]).select("event_id", "last_ts")
