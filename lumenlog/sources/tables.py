"""Writing and reading the stored tables, guarded SQL and report files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from lumenlog.schemas import TABLE_LAYOUT, TABLES, conform
from lumenlog.session import run_dir


def append(df: DataFrame, table: str, root: str) -> None:
    """Append rows to a stored table, one folder per day, sorted inside each file."""
    ts, order = TABLE_LAYOUT[table]
    rows = conform(df, TABLES[table]).withColumn("dt", F.to_date(ts))
    # Rows of one day spread over several writers, so a busy day is not one task.
    rows.repartition("dt", F.pmod(F.xxhash64(*order), F.lit(32))).sortWithinPartitions(
        "dt", *order
    ).write.mode("append").partitionBy("dt").parquet(f"{root}/{table}")


def read(spark: SparkSession, table: str, root: str) -> DataFrame:
    schema = StructType([*TABLES[table].fields, StructField("dt", DateType())])
    return spark.read.schema(schema).parquet(f"{root}/{table}")


def delete_incidents(spark: SparkSession, ids: DataFrame, root: str) -> None:
    """Remove incidents from every incident table, rewriting only the days that hold them.

    The kept rows go to a staging folder first, so a lost executor cannot leave a day half
    written from its own input.
    """
    for table in ("incidents", "incident_events", "incident_candidates"):
        stored = read(spark, table, root)
        gone = ids.select("incident_id").distinct()
        days = stored.join(gone, "incident_id", "left_semi").select("dt").distinct()
        touched = stored.join(days, "dt", "left_semi")
        kept = touched.join(gone, "incident_id", "left_anti")
        emptied = days.join(kept.select("dt").distinct(), "dt", "left_anti")
        staging = run_dir(spark, f"delete-{table}")
        kept.write.partitionBy("dt").parquet(staging)
        empty_days = [r["dt"] for r in emptied.collect()]  # at most one row per day
        staged = spark.read.schema(stored.schema).parquet(staging)
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "dt"
        ).parquet(f"{root}/{table}")
        for day in empty_days:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}/dt={day}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out


def guarded_sql(spark: SparkSession, text: str) -> DataFrame:
    """Run an ad-hoc query over registered views: one SELECT that carries a LIMIT."""
    body = text.strip()
    body = re.sub(r"^```(?:sql)?|```$", "", body).strip()
    body = re.sub(r"^`|`$", "", body).strip()
    lowered = body.lower()
    if not lowered.startswith("select"):
        raise ValueError("only SELECT statements are allowed")
    if "limit" not in lowered:
        raise ValueError("the statement needs a LIMIT")
    return spark.sql(body)


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    df.write.mode("overwrite").json(path)


def markdown_table(df: DataFrame) -> DataFrame:
    """Each row of a small summary as one line of a Markdown table, in column ``line``."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.select(
        F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")
    )


def append_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("append").parquet(path)


def list_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.desc("created_at"), "id")


def load_report(spark: SparkSession, path: str, report_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("id") == report_id)
