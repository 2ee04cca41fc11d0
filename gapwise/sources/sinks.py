"""Writers for features, audits and fitted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite", by: str | None = None) -> None:
    """The output committer publishes complete files only."""
    writer = df.write.mode(mode)
    if by:
        writer = writer.partitionBy(by)
    if form == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(form).save(path)


def write_audit(df: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON object per line."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def save_stats(stats: DataFrame, path: str, epsilon: float | None = None) -> None:
    """Robust statistics (level, uid, session_id, hour, x_med, x_mad, x_smad, n) and the ``epsilon`` they were fitted with."""
    if epsilon is not None:
        stats = stats.withColumn("epsilon", F.lit(float(epsilon)))
    stats.write.mode("overwrite").parquet(path)


def load_stats(spark: SparkSession, path: str, floor: float = 1e-12) -> DataFrame:
    """Epsilon and scales are floored; a missing scale is derived from the deviation.

    Keys with an all-hours row (``hour`` NULL) get all hours from 0 to 23: what an hour lacks comes from that row.
    """
    s = spark.read.parquet(path)
    if "epsilon" not in s.columns:
        s = s.withColumn("epsilon", F.lit(None).cast("double"))
    s = s.withColumn("x_smad", F.coalesce(F.col("x_smad"), F.col("x_mad") * 1.4826)).withColumn(
        "x_mad", F.coalesce("x_mad", F.col("x_smad") / 1.4826)
    )
    names = ["x_med", "x_mad", "x_smad", "epsilon"]
    keys = [c for c in s.columns if c not in ("hour", "n", *names)]
    rest = [c for c in s.columns if c not in (*keys, "hour")]
    own = s.select(*keys, "hour", F.struct(*rest).alias("own"))
    hours = F.explode(F.sequence(F.lit(0), F.lit(23)).cast(f"array<{s.schema['hour'].dataType.simpleString()}>")).alias("hour")
    parent = s.where("hour IS NULL").select(*keys, hours, F.struct(*names).alias("parent"))
    rows = own.unionByName(parent, allowMissingColumns=True).groupBy(*keys, "hour").agg(
        F.first("own", True).alias("own"), F.first("parent", True).alias("parent")
    )
    filled = {c: F.coalesce(f"own.{c}", f"parent.{c}") if c in names else F.col(f"own.{c}") for c in rest}
    for c in ("x_smad", "epsilon"):
        filled[c] = F.greatest(F.coalesce(filled[c], F.lit(floor)), F.lit(floor))
    filled["x_mad"] = F.coalesce(filled["x_mad"], filled["x_smad"] / 1.4826)
    return rows.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in s.columns])
