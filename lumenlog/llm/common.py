"""What the operators share: reading tables, storing intermediate tables, ids and folds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.session import run_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, its size is known."""
    path = run_dir(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def row_key() -> Column:
    """SHA-256 of doc_id and text: what tells rows apart where ids are null or repeated. Null texts count as empty."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return F.unhex(F.sha2(key, 256))


def texts(batch: pd.DataFrame) -> Iterator[tuple[object, str]]:
    """(doc_id or None, text or '') of the rows of a batch whose first two columns are id and text."""
    ids = batch.iloc[:, 0]
    missing = ids.isna()
    for i, (key, text) in enumerate(zip(ids, batch.iloc[:, 1])):
        yield (None if missing.iloc[i] else int(key)), (text if isinstance(text, str) else "")


def frame(rows: Iterable[tuple], columns: list[str], ids: tuple[str, ...] = ("doc_id",)) -> pd.DataFrame:
    """Rows as a frame whose id columns are nullable integers."""
    out = pd.DataFrame(list(rows), columns=columns)
    for name in ids:
        out[name] = out[name].astype("Int64")
    return out
