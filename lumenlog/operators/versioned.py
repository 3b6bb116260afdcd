"""Latest-version reads, de-duplication and deletes over append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], version: str, ties: list[str] | None = None) -> DataFrame:
    """The row with the highest version per key, as a partially aggregated maximum."""
    order = F.struct(version, *(ties or []))
    row = F.max_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def dedup_latest(df: DataFrame, keys: list[str], version: str, ties: list[str] | None = None) -> DataFrame:
    """Same result through a ranked window, which is limited per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version), *[F.desc(t) for t in ties or []])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def delete_keys(tables: dict[str, DataFrame], ids: DataFrame, key: str = "incident_id") -> dict[str, DataFrame]:
    """Each table without the rows of the listed ids."""
    gone = ids.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}
