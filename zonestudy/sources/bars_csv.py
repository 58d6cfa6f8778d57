"""Bar exports as text: what layout a file has, and its rows as clean UTC bars."""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from datetime import datetime
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
# Names under which exports hold each role, without case and punctuation.
ALIASES = {
    "open": ("open", "o", "bidopen", "openbid", "openprice"),
    "high": ("high", "h", "bidhigh", "highbid", "highprice"),
    "low": ("low", "l", "bidlow", "lowbid", "lowprice"),
    "close": ("close", "c", "bidclose", "closebid", "closeprice", "last"),
    "volume": ("volume", "vol", "v", "tickvol", "tickvolume", "realvolume", "bidvolume", "volumefrom"),
    "datetime": ("datetime", "timestamp", "dt", "gmttime", "localtime", "opentime", "bartime", "servertime"),
    "date": ("date",),
    "time": ("time",),
}
# Timestamp formats in the order they are tried; day-first comes before month-first.
FORMATS = (
    "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y.%m.%d %H:%M:%S", "%Y.%m.%d %H:%M", "%Y.%m.%d", "%Y/%m/%d %H:%M:%S", "%Y/%m/%d %H:%M",
    "%d.%m.%Y %H:%M:%S", "%d.%m.%Y %H:%M", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y %H:%M", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M", "%Y%m%d %H:%M:%S", "%Y%m%d%H%M%S",
)
_CLOCK = re.compile(r"\d{1,2}:\d{2}(:\d{2})?")
_OFFSET = r"\d(Z|[+-]\d{2}(:?\d{2})?)$"
DELIMITERS = ("\t", ";", "|", ",")


@dataclass(frozen=True)
class BarFormat:
    """``roles``: role -> column index, with ``datetime``, or ``date`` and ``time``; ``width``: columns of a row. ``ts_format`` is None where no
    one format fits. ``preview`` holds the first rows as they were read, the header first if there is one."""

    delimiter: str
    decimal: str
    header: bool
    roles: dict[str, int]
    width: int
    ts_format: str | None
    ambiguous_date: bool
    preview: tuple[tuple[str, ...], ...] = ()

    def key(self) -> tuple:
        return (self.delimiter, self.decimal, self.header, tuple(sorted(self.roles.items())), self.width, self.ts_format)


def _moment(text: str, fmt: str | None = None) -> datetime | None:
    """The time that ``text`` names in a format or, without one, in ISO's; None if it names none."""
    try:
        return datetime.strptime(text, fmt) if fmt else datetime.fromisoformat(text)
    except ValueError:
        return None


def _when(texts: list[str]) -> tuple[str | None, list[datetime]]:
    """The format that most texts fit, and more than half do, the first of equal ones, and their times; if there is none, times in any format."""
    best = max(FORMATS, key=lambda f: sum(_moment(t, f) is not None for t in texts))
    found = [m for m in (_moment(t, best) for t in texts) if m]
    if 2 * len(found) > len(texts):
        return best, found
    return None, [m for m in (_any_moment(t) for t in texts) if m]


def _any_moment(text: str) -> datetime | None:
    """The time that a cell names in any format, be it without a clock."""
    return next((m for t in (text, f"{text} 00:00") for f in (*FORMATS, None) if (m := _moment(t, f))), None)


def _is_number(text: str, decimal: str) -> bool:
    try:
        float(text.replace(" ", "").replace(decimal, ".") if decimal == "." or "." not in text else "x")
    except ValueError:
        return False
    return True


class _Columns:
    """The cells of some lines under one delimiter, and what each column can be."""

    def __init__(self, lines: list[str], delimiter: str) -> None:
        self.delimiter = delimiter
        cells = [tuple(c.strip().strip('"').strip() for c in x.split(delimiter)) for x in lines]
        self.first, self.width = cells[0], len(cells[0])
        self.header = not any(_any_moment(c) or _is_number(c, ".") or _is_number(c, ",") for c in self.first if c)
        body = [r for r in cells[self.header :] if len(r) >= min(self.width, 5)]
        self.columns = [[r[k] for r in body if k < len(r)] for k in range(self.width)] if body else []
        self.cells = tuple(cells)

    def mostly(self, k: int, test) -> bool:
        """Whether more than half of a column's cells pass: single bad rows don't hide a layout."""
        own = self.columns[k] if k < len(self.columns) else []
        return 2 * sum(map(bool, map(test, own))) > len(own)

    def is_price(self, k: int) -> bool:
        return self.mostly(k, lambda c: _is_number(c, ".") or (self.delimiter != "," and _is_number(c, ",")))

    def is_clock(self, k: int) -> bool:
        return self.mostly(k, _CLOCK.fullmatch)

    def is_moment(self, k: int) -> bool:
        return self.mostly(k, _any_moment)

    def named(self) -> dict[str, int]:
        """Roles that the header's names give, each to the first column of that name whose cells fit."""
        if not self.header:
            return {}
        plain = [re.sub(r"[^a-z0-9]", "", c.lower()) for c in self.first]
        roles = {}
        for role, names in ALIASES.items():
            fits = self.is_price if role in (*PRICES, "volume") else self.is_clock if role == "time" else self.is_moment
            here = [k for k, c in enumerate(plain) if c in names]
            roles |= {role: k for k in reversed(here) if role == "volume" or fits(k)}
        alone = [k for k, c in enumerate(plain) if c in ALIASES["time"] and self.is_moment(k) and not self.is_clock(k)]
        return roles | ({"datetime": alone[0]} if alone and "datetime" not in roles else {})

    def placed(self, roles: dict[str, int]) -> dict[str, int]:
        """``roles`` with what they lack by position: the first column of times, with a clock beside it, then the next columns of numbers."""
        roles = dict(roles)
        if "datetime" not in roles and "date" not in roles:
            start = next((k for k in range(self.width) if self.is_moment(k)), None)
            if start is None:
                return roles
            roles["date" if self.is_clock(start + 1) else "datetime"] = start
        if "date" in roles and "time" not in roles:
            beside = roles["date"] + 1
            roles |= {"time": beside} if self.is_clock(beside) else {"datetime": roles.pop("date")}
        if "datetime" in roles:
            roles = {k: v for k, v in roles.items() if k not in ("date", "time")}
        if not set(PRICES) <= roles.keys():
            last = max(roles[k] for k in ("datetime", "date", "time") if k in roles)
            numbers = [k for k in range(last + 1, self.width) if self.is_price(k)]
            roles |= {p: k for p, k in zip((*PRICES, "volume"), numbers, strict=False) if p not in roles}
        return roles


def detect_bar_format(lines: list[str], name: str = "file") -> BarFormat:
    """The layout of a file from its first lines: the delimiter under which columns read as times and prices. Raises ValueError that
    says what each delimiter lacks."""
    lines = [x.lstrip("\ufeff").rstrip("\r\n") for x in lines if x.strip()][:50]
    if not lines:
        raise ValueError(f"{name} is empty")
    lacks = []
    for delimiter in DELIMITERS:
        if delimiter not in lines[-1]:
            continue
        table = _Columns(lines, delimiter)
        roles = table.placed(table.named())
        missing = [p for p in PRICES if p not in roles] + ([] if {"datetime", "date"} & roles.keys() else ["timestamp"])
        if missing or not table.columns:
            lacks.append(f"by {delimiter!r} no {', '.join(missing) or 'rows'}; header row {table.first if table.header else None}, at least 5 columns of timestamp and prices are needed")
            continue
        at = [roles["datetime"]] if "datetime" in roles else [roles["date"], roles["time"]]
        fmt, found = _when([" ".join(x) for x in zip(*(table.columns[k] for k in at), strict=True)])
        prices = [c for p in PRICES for c in table.columns[roles[p]]]
        decimal = "," if delimiter != "," and any("," in c and _is_number(c, ",") for c in prices) else "."
        either = bool(fmt) and not fmt.startswith("%Y") and all(m.day <= 12 for m in found)
        return BarFormat(delimiter, decimal, table.header, roles, table.width, fmt, either, table.cells[:6])
    raise ValueError(f"{name}: " + ("; ".join(lacks) or "no comma, semicolon, tab or pipe separates columns"))


#: Bytes of a file that the scan for heads takes as one piece: all of it.
_WHOLE = 1 << 40
#: Bytes up to which a file is read whole for its head, and larger files whose heads one job reads.
_SMALL, _TOGETHER = 4 << 20, 64
#: Files up to which their symbols are broadcast, some MB.
_LISTED = 50_000


def _heads(spark: SparkSession, files: dict[str, int], n_lines: int) -> Iterator[DataFrame]:
    """value and file_path of the lines of ``files`` (path, length), a file a task, its first ``n_lines`` in order and in one batch. All small files are one
    read; of a larger one no more than its first lines are read, so each is a branch with a limit, many of them a job.

    Each file is one piece of the scan whatever its length, so a task begins with its first line."""
    own = spark.newSession()  # the pieces are a setting of the session
    for name in ("maxPartitionBytes", "openCostInBytes"):
        own.conf.set(f"spark.sql.files.{name}", str(_WHOLE))
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n_lines))
    lines = lambda paths: own.read.text(paths).select("value", "_metadata.file_path", "_metadata.file_block_start").filter("file_block_start = 0")
    if small := [p for p, n in files.items() if n <= _SMALL]:
        yield lines(small)
    large = [p for p, n in files.items() if n > _SMALL]
    for at in range(0, len(large), _TOGETHER):
        yield reduce(DataFrame.unionByName, [lines([p]).limit(n_lines) for p in large[at : at + _TOGETHER]])


def layouts(spark: SparkSession, paths: list[str], n_lines: int = 50) -> dict[str, BarFormat]:
    """The layout of each file under ``paths`` (files or folders), by its full path: told in the tasks that read the first lines.
    Raises ValueError for the first file that has none, and warns of dates that can be read day or month first."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            file, fmt, wrong = rows["file_path"][0], None, None
            try:
                fmt = json.dumps(asdict(detect_bar_format(rows["value"], _name(file))))
            except ValueError as e:
                wrong = str(e)
            yield pa.RecordBatch.from_arrays([pa.array([x], type=pa.string()) for x in (file, fmt, wrong)], names=["file", "fmt", "wrong"])
            return

    listed = dict(spark.read.format("binaryFile").load(paths).select("path", "length").orderBy("path").collect())  # a row for each file, as its reader lists them, too
    rows = {_plain(r.file): r for lines in _heads(spark, listed, n_lines) for r in lines.mapInArrow(told, "file string, fmt string, wrong string").collect()}
    found = {}
    for path in listed:
        r = rows[_plain(path)]
        if r.wrong:
            raise ValueError(r.wrong)
        d = json.loads(r.fmt)
        found[path] = BarFormat(**d | {"preview": tuple(map(tuple, d["preview"]))})
        if found[path].ambiguous_date:
            warnings.warn(f"{path}: dates can be read day or month first; read as {found[path].ts_format}", stacklevel=2)
    return found


def _plain(path: str) -> str:
    """A path without its scheme's slashes and escapes, which readers write in different ways."""
    return re.sub(r"^(\w+):/+", r"\1:/", unquote(path))


def _name(path: str) -> str:
    return unquote(path.rstrip("/").rsplit("/", 1)[-1])


def sniff(spark: SparkSession, paths: list[str], n_lines: int = 50) -> dict[str, BarFormat]:
    """The layout of each of some files, by the path they are given by."""
    found = {_plain(p): fmt for p, fmt in layouts(spark, paths, n_lines).items()}
    return {p: fmt for p in paths for full, fmt in found.items() if full == _plain(p) or full == f"file:{_plain(p)}"}


def _pattern(fmt: str) -> str:
    """The format as Spark writes it; single letters take one digit or two."""
    compact = "%Y%m%d" in fmt
    letters = {"%Y": "yyyy", "%m": "MM" if compact else "M", "%d": "dd" if compact else "d", "%H": "HH" if compact else "H", "%M": "mm", "%S": "ss"}
    return re.sub(r"%.", lambda m: letters[m[0]], fmt)


def parse_bar_timestamp(fmt: BarFormat, cell, tz: str = "UTC") -> Column:
    """The wall clock of a row (timestamp without zone) from its text cells; null where it can't be read.

    Where the file has no one format, all are tried, then what Spark itself reads, such as ISO times with a T or parts of a second; a time
    with an offset from UTC is turned to the wall clock of ``tz``."""
    patterns = [fmt.ts_format] if fmt.ts_format else list(FORMATS)
    if "datetime" in fmt.roles:
        text = F.trim(cell(fmt.roles["datetime"]))
    else:
        time = F.trim(cell(fmt.roles["time"]))
        time = F.when(F.length(time) - F.length(F.replace(time, F.lit(":"), F.lit(""))) == 1, F.concat(time, F.lit(":00"))).otherwise(time)
        text = F.concat_ws(" ", F.trim(cell(fmt.roles["date"])), time)
        patterns = list(dict.fromkeys(f"{p.split(' ')[0]} %H:%M:%S" for p in patterns))
    tried = [F.try_to_timestamp(text, F.lit(_pattern(p))).cast("timestamp_ntz") for p in patterns]
    if fmt.ts_format:
        return F.coalesce(*tried)
    there = F.from_utc_timestamp(text.try_cast("timestamp"), tz or "UTC").cast("timestamp_ntz")
    return F.coalesce(*tried, F.when(text.rlike(_OFFSET) & text.contains(":"), there).otherwise(text.try_cast("timestamp_ntz")))


def localize_to_utc(wall: Column, tz: str) -> Column:
    """A wall clock (taken as if in UTC) in zone ``tz`` as UTC: null in an hour that autumn repeats; in one that spring leaves out, the first
    instant after it."""
    if tz in ("", "UTC", None):
        return wall
    u = F.to_utc_timestamp(wall, tz)
    again = lambda step: F.from_utc_timestamp(u + F.expr(step), tz) == wall
    back = F.from_utc_timestamp(u, tz)
    shift = F.unix_micros(back) - F.unix_micros(wall)
    after = F.to_utc_timestamp(F.timestamp_micros(F.unix_micros(F.date_trunc("hour", wall)) + shift), tz)
    return F.when(again("interval 1 hour") | again("interval 30 minutes"), None).when(back != wall, after).otherwise(u)


def clean_files(raw: DataFrame, tz: str = "UTC") -> DataFrame:
    """symbol, file, ts, open, high, low, close, volume from rows with wall (as UTC), prices, ``file``, ``block`` and ``row`` (place in the file), each file by itself.

    Rows without time or price go; of one wall clock the first row stays, of two wall clocks that are one time the first one, and bars whose prices
    contradict each other go."""
    raw = raw.dropna(subset=["wall", *PRICES]).withColumn("ts", localize_to_utc(F.col("wall"), tz)).filter("ts is not null")
    # first rows by grouped minimum, not by a sort of all rows
    own = raw.groupBy("symbol", "file", "ts").agg(F.min(F.struct("wall", "block", "row", *PRICES, "volume")).alias("r"))
    own = own.select("symbol", "file", "ts", *[F.col(f"r.{c}").alias(c) for c in (*PRICES, "volume")])
    return own.filter("high >= low and high >= open and high >= close and low <= open and low <= close")


def first_of_files(own: DataFrame) -> DataFrame:
    """Of the bars that several files have for one time, the first file's."""
    one = own.groupBy("symbol", "ts").agg(F.min(F.struct("file", *PRICES, "volume")).alias("r"))
    return one.select("symbol", "ts", *[F.col(f"r.{c}").alias(c) for c in (*PRICES, "volume")])


def clean_bars(raw: DataFrame, tz: str = "UTC") -> DataFrame:
    """symbol, ts, open, high, low, close, volume: each file cleaned by itself, then of one time the bar of the first file."""
    return first_of_files(clean_files(raw, tz))


def read_rows(spark: SparkSession, files: DataFrame, tz: str = "UTC", fmt: BarFormat | None = None) -> DataFrame:
    """The rows of ``files`` (path, symbol) as ``clean_files`` takes them: as many reads as there are layouts, whatever the number of symbols. A file can be of
    several symbols. Raises ValueError for a file without times or prices among its first rows.

    Rows get their symbols by their file, over a broadcast of the list while that has at most 50,000 files."""
    rows = files.select("path", "symbol").distinct().collect()  # a row for each file, which the driver lists for each read anyway
    if not rows:
        raise FileNotFoundError("no files of bars")
    paths = sorted({r.path for r in rows})
    groups: dict[tuple, tuple[BarFormat, list[str]]] = {}
    for p, own in (dict.fromkeys(paths, fmt) if fmt else layouts(spark, paths)).items():
        groups.setdefault(own.key(), (own, []))[1].append(p)
    raw = reduce(DataFrame.unionByName, [_raw(spark, own, some, tz) for own, some in groups.values()])
    symbols = {r.symbol for r in rows}
    if len(symbols) == 1 and len(rows) == len(paths):
        return raw.withColumn("symbol", F.lit(symbols.pop()))
    of = spark.createDataFrame([(_plain(r.path), r.symbol) for r in rows], "_file string, symbol string")
    of = F.broadcast(of) if len(rows) <= _LISTED else of
    return raw.join(of, plain_path("file") == F.col("_file")).drop("_file")


def plain_path(path: str) -> Column:
    """A column of paths, written as readers and listings both can be."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"^(\w+):/+", "$1:/")


def read_exports(spark: SparkSession, files: DataFrame, tz: str = "UTC", fmt: BarFormat | None = None) -> DataFrame:
    """Clean bars of all symbols from ``files`` (path, symbol), read as ``read_rows`` does."""
    return clean_bars(read_rows(spark, files, tz, fmt), tz)


def read_bars_csv(spark: SparkSession, paths: list[str], symbol: str, tz: str = "UTC", fmt: BarFormat | None = None) -> DataFrame:
    """Clean bars of one symbol from files, or folders of files, of any supported layouts; each layout is one read over its files. Raises ValueError
    for a file without times or prices among its first rows."""
    if not paths:
        raise FileNotFoundError(f"no files for {symbol!r}")
    files = spark.read.format("binaryFile").load(paths).select("path", F.lit(symbol).alias("symbol"))
    listed = [_plain(r.path) for r in files.collect()]  # empty files aren't listed
    for p in paths:
        own = re.compile(rf"(\w+:)?{re.escape(_plain(p).rstrip('/'))}(/|$)")
        if not any(own.match(f) for f in listed):
            raise ValueError(f"{_name(p)} is empty")
    return read_exports(spark, files, tz, fmt)


def _raw(spark: SparkSession, fmt: BarFormat, files: list[str], tz: str) -> DataFrame:
    names = [f"c{i}" for i in range(fmt.width)]
    schema = ", ".join(f"{n} string" for n in names) + ", _broken string"
    reader = spark.read.schema(schema).options(sep=fmt.delimiter, header=fmt.header, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken", enforceSchema=True)
    rows = reader.csv(files).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    # a row with too many fields is malformed, one with too few lacks them
    rows = rows.filter(F.coalesce(F.size(F.split("_broken", re.escape(fmt.delimiter))) <= fmt.width, F.lit(True)))

    def number(role: str) -> Column:
        if role not in fmt.roles:
            return F.lit(None).cast("double")
        text = F.replace(F.col(names[fmt.roles[role]]), F.lit(" "), F.lit(""))
        x = F.replace(text, F.lit(","), F.lit(".")).try_cast("double")
        return F.when(~F.isnan(x), x)

    wall = parse_bar_timestamp(fmt, lambda i: F.col(names[i]), tz).cast("timestamp")
    return rows.select("file", "block", "row", wall.alias("wall"), *[number(r).alias(r) for r in (*PRICES, "volume")])
