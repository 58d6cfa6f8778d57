"""Bars and events as Parquet, and a short identity of a set of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bars_parquet(bars: DataFrame, path: str, mode: str = "overwrite", dynamic: bool = False) -> None:
    """Bars by symbol and year, in order within a file; a year of one symbol is one task's work. With ``dynamic`` only the symbols' years that
    ``bars`` has are replaced."""
    out = bars.withColumn("year", F.year("ts")).repartition("symbol", "year").sortWithinPartitions("symbol", "year", "ts")
    writer = out.write.mode(mode).option("compression", "snappy")
    (writer.option("partitionOverwriteMode", "dynamic") if dynamic else writer).partitionBy("symbol", "year").parquet(path)


def remove_bars(spark: SparkSession, path: str, symbol: str, year: int) -> None:
    """Deletes one year of one symbol from a table of bars."""
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(symbol)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/symbol={name}/year={year}")
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def read_bars_parquet(spark: SparkSession, path: str, symbols: list[str] | None = None, years: tuple[int, int] | None = None) -> DataFrame:
    """Bars of some symbols and years; other folders aren't read."""
    bars = spark.read.parquet(path)
    if symbols:
        bars = bars.filter(F.col("symbol").isin(symbols))
    if years:
        bars = bars.filter(F.col("year").between(*years))
    return bars.select(F.col("symbol").cast("string").alias("symbol"), "ts", "open", "high", "low", "close", "volume")


def dataset_fingerprint(bars: DataFrame) -> DataFrame:
    """symbol, data_fingerprint: a hash of the bars' count, first and last time, and first and last close."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
    g = bars.groupBy("symbol").agg(
        F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.min_by("close", "ts").alias("x"), F.max_by("close", "ts").alias("y")
    )
    zone = lambda c: F.replace(iso(c), F.lit("Z"), F.lit("+00:00"))
    text = F.concat_ws("|", F.col("n").cast("string"), zone("a"), zone("b"), F.format_string("%.6f", "x"), F.format_string("%.6f", "y"))
    return g.select("symbol", F.substring(F.sha1(text), 1, 12).alias("data_fingerprint"))


def write_events(events: DataFrame, path: str, study_id: str) -> None:
    """A study's events under ``path``/study_id=..., replacing those it had."""
    events.write.mode("overwrite").parquet(f"{path}/study_id={study_id}")


def read_events(spark: SparkSession, path: str, study_id: str) -> DataFrame:
    return spark.read.parquet(f"{path}/study_id={study_id}")


def export_events_csv(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").option("header", True).csv(path)
