"""Nearest prototypes and density clusters of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.stats import cosine

#: Prototypes that are broadcast at most; more are an error, not a bigger broadcast.
MOST_PROTOTYPES = 10_000


def cosine_topk(rows: DataFrame, prototypes: DataFrame, k: int) -> DataFrame:
    """The k prototypes(proto_id, proto) of the highest cosine for each row(id, vector), ranked. Each row's
    prototypes are ranked inside the row, so nothing is shuffled."""
    n = prototypes.limit(MOST_PROTOTYPES + 1).count()
    if n > MOST_PROTOTYPES:
        raise ValueError(f"more than {MOST_PROTOTYPES} prototypes")
    listed = prototypes.groupBy().agg(F.collect_list(F.struct("proto_id", "proto")).alias("protos"))
    near = F.transform("protos", lambda p: F.struct((-cosine(F.col("vector"), p["proto"])).alias("d"), p["proto_id"].alias("proto_id")))
    best = F.slice(F.array_sort(near), 1, k)
    out = rows.join(F.broadcast(listed)).select("id", F.posexplode(best).alias("rank", "near"))
    return out.select("id", (F.col("rank") + 1).alias("rank"), F.col("near.proto_id").alias("proto_id"), (-F.col("near.d")).alias("similarity"))


def shift_breaks(rows: DataFrame, by: str, order: str, vector: str, jump: float = 0.15) -> DataFrame:
    """Groups of consecutive rows: a new one where the cosine to the row before changes by more than jump."""
    w = Window.partitionBy(by).orderBy(order)
    out = rows.withColumn("sim", cosine(F.lag(vector).over(w), F.col(vector)))
    out = out.withColumn("brk", F.coalesce((F.abs(F.col("sim") - F.lag("sim").over(w)) > jump).cast("int"), F.lit(0)))
    return out.withColumn("grp", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
