"""Folders of bar exports, one or more files for a symbol."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonestudy.sources.bars_csv import clean_files, first_of_files, plain_path, read_exports, read_rows
from zonestudy.sources.scratch import kept
from zonestudy.sources.tables import remove_bars, write_bars_parquet


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modified, name and stem of the .csv and .txt files in a folder; their contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,txt,CSV,TXT}").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    return found.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", ""))


def _own_symbol() -> Column:
    """What a file's name begins with, without the bar length, in capitals."""
    first = F.element_at(F.split("stem", r"[_\-. ]"), 1)
    return F.upper(F.regexp_replace(first, r"(?i)(M1|M5|M15|H1|D1)$", ""))


def list_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """symbol, in order: what file names begin with, without the bar length, in capitals."""
    return _files(spark, folder).select(_own_symbol().alias("symbol")).filter("symbol != ''").distinct().orderBy("symbol")


def symbol_files(files: DataFrame, symbols: DataFrame, years: tuple[int, int] | None = None) -> DataFrame:
    """symbol and path of the files whose names begin with each symbol. With ``years``, files named for other years only are left out, unless that
    leaves a symbol none.

    A name meets the symbols by all its beginnings, so files and symbols aren't compared pair by pair."""
    begins = files.withColumn("symbol", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("stem"), F.lit(1))), lambda n: F.substring(F.upper("stem"), F.lit(1), n))))
    own = begins.join(symbols.select("symbol").distinct(), "symbol")
    if years:
        named = F.regexp_extract_all("stem", F.lit(r"((?:19|20)\d{2})"), F.lit(1))
        own = own.withColumn("fits", (F.size(named) == 0) | F.exists(named, lambda y: y.cast("int").between(*years)))
        some = own.groupBy("symbol").agg(F.max("fits").alias("some"))
        own = own.join(some, "symbol").filter("fits or not some")
    return own.select("symbol", "path")


def load_folder(spark: SparkSession, folder: str, tz: str = "UTC", years: tuple[int, int] | None = None) -> DataFrame:
    """The bars of all symbols of a folder, each from the files whose names begin with it, in as many reads as the folder has layouts. The rows of
    files that ``years`` leaves in aren't trimmed. A folder without bar files is a FileNotFoundError."""
    files = _files(spark, folder)
    symbols = files.select(_own_symbol().alias("symbol")).filter("symbol != ''")
    return read_exports(spark, symbol_files(files, symbols, years), tz)


def load_symbol_folder(spark: SparkSession, folder: str, symbol: str, tz: str = "UTC", years: tuple[int, int] | None = None) -> DataFrame:
    """The bars of all files whose names begin with ``symbol``. With ``years``, files named for other years only are left out, unless
    that leaves none; the rows of the others aren't trimmed."""
    own = symbol_files(_files(spark, folder), spark.createDataFrame([(symbol.upper(),)], "symbol string"), years)
    if own.isEmpty():
        raise FileNotFoundError(f"no .csv or .txt file in {folder} begins with {symbol!r}")
    return read_exports(spark, own, tz)


_LOADED = "path string, length long, modified timestamp, symbol string, years array<int>, load long"


def _last_load(spark: SparkSession, path: str) -> DataFrame:
    """What the last whole load under ``path`` had read: a row for each file and symbol, with the years of its bars; none before the first."""
    try:
        loads = spark.read.schema(_LOADED).parquet(f"{path}/_loads")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LOADED)
    return loads.join(F.broadcast(loads.agg(F.max("load").alias("load"))), "load", "left_semi")


def update_folder(spark: SparkSession, folder: str, path: str, tz: str = "UTC") -> int:
    """Brings the bars table under ``path`` (see ``write_bars_parquet``) up to date with the exports in ``folder``; returns how many files were parsed.

    A list of the files read, with lengths, times and the years of their bars, is kept beside the table. Files that are as they were aren't parsed, unless one that
    changed, came or went has bars in one of their years; only the folders of such symbols and years are written again, or deleted
    where no file has bars for them any more. The list is written last: what a load that broke off had to do is done by the next one."""
    files = _files(spark, folder)
    symbols = files.select(_own_symbol().alias("symbol")).filter("symbol != ''")
    now = kept(symbol_files(files, symbols).join(files.select("path", "length", "modified"), "path").select("path", "length", "modified", "symbol"))
    before = kept(_last_load(spark, path))
    keys = ["path", "length", "modified", "symbol"]
    came, gone = kept(now.join(before, keys, "left_anti")), before.join(now, keys, "left_anti")
    if came.isEmpty() and gone.isEmpty():
        return 0
    year = F.year("ts").alias("year")
    rows = lambda some: clean_files(read_rows(spark, some, tz), tz)
    none = spark.createDataFrame([], "symbol string, file string, ts timestamp, open double, high double, low double, close double, volume double")
    fresh = kept(none if came.isEmpty() else rows(came))
    touched = kept(fresh.select("symbol", year).unionByName(gone.select("symbol", F.explode("years").alias("year"))).distinct())
    same = before.join(now, keys, "left_semi")
    beside = kept(same.withColumn("year", F.explode("years")).join(touched, ["symbol", "year"], "left_semi").select("path", "symbol").distinct())
    own = fresh if beside.isEmpty() else fresh.unionByName(rows(beside))
    bars = kept(first_of_files(own).withColumn("year", F.year("ts")).join(touched, ["symbol", "year"], "left_semi").drop("year"))
    if not bars.isEmpty():
        write_bars_parquet(bars, path, dynamic=True)
    for r in touched.join(bars.select("symbol", year).distinct(), ["symbol", "year"], "left_anti").collect():  # folders that hold nothing now
        remove_bars(spark, path, r.symbol, r.year)
    years = fresh.groupBy("symbol", plain_path("file").alias("_file")).agg(F.array_sort(F.collect_set(F.year("ts"))).alias("years"))
    read = came.withColumn("_file", plain_path("path")).join(years, ["symbol", "_file"], "left").drop("_file").withColumn("years", F.coalesce("years", F.array().cast("array<int>")))
    load = (before.agg(F.max("load")).first()[0] or 0) + 1
    listed = same.drop("load").unionByName(read).withColumn("load", F.lit(load).cast("long"))
    listed.select("path", "length", "modified", "symbol", "years", "load").coalesce(1).write.mode("append").parquet(f"{path}/_loads")
    return came.select("path").unionByName(beside.select("path")).distinct().count()
