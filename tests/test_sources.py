"""Bar exports of many layouts, clocks, folders, Parquet, and the registry."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.walks import walk
from zonestudy.operators import stats as G
from zonestudy.plans.spec import Spec
from zonestudy.sources import bars_csv, folders, tables
from zonestudy.sources.registry import Registry, family_key

BARS = [("2023-08-15", "22:59", 87.25, 87.5, 87.0, 87.1, 41), ("2023-08-15", "23:00", 87.1, 88.4, 87.05, 88.3, 17), ("2023-08-16", "00:07", 88.3, 88.3, 86.9, 86.95, 5)]


def export(header, sep, write):
    return "\n".join([*([sep.join(header)] if header else []), *(sep.join(write(*b)) for b in BARS)]) + "\n"


def comma(x):
    return f"{x:.3f}".replace(".", ",")


NAMES = ["Open", "High", "Low", "Close"]
EXPORTS = {
    "bracketed names by tab": export(["<DATE>", "<TIME>", *(f"<{n.upper()}>" for n in NAMES), "<TICKVOL>", "<SPREAD>"], "\t", lambda d, t, *p: [d.replace("-", "."), f"{t}:00", *map(str, p), "3"]),
    "one column of time": export(["Bar Time", *NAMES, "Vol"], ";", lambda d, t, *p: [f"{d} {t}:00", *map(str, p)]),
    "nothing but rows": export(None, ",", lambda d, t, *p: [d.replace("-", "."), t, *map(str, p)]),
    "digits only": export(["Timestamp", *NAMES], ",", lambda d, t, *p: [(d + t).replace("-", "").replace(":", "") + "00", *map(str, p[:4])]),
    "day first, decimal commas": export(["Date", "Time", *NAMES, "Volume"], ";", lambda d, t, *p: [".".join(reversed(d.split("-"))), t, *map(comma, p[:4]), str(p[4])]),
    "decimal commas by tab, no volume": export(["Time", *NAMES], "\t", lambda d, t, *p: [f"{d.replace('-', '/')} {t}", *map(comma, p[:4])]),
    "strange names": export(["no", "when", "clock", "first", "top", "bottom", "end", "n"], "|", lambda d, t, *p: ["x", d, t, *map(str, p)]),
    "prices in another order": export(["Close", "Low", "High", "Open", "DateTime"], ",", lambda d, t, *p: [str(p[3]), str(p[2]), str(p[1]), str(p[0]), f"{d} {t}"]),
    "ISO": export(["Timestamp", *NAMES], ",", lambda d, t, *p: [f"{d}T{t}:00", *map(str, p[:4])]),
    "ISO with parts of a second": export(["timestamp", *NAMES], ",", lambda d, t, *p: [f"{d} {t}:00.000", *map(str, p[:4])]),
    "ISO with an offset": export(["timestamp", *NAMES], ",", lambda d, t, *p: [f"{d}T{t}:00-04:00", *map(str, p[:4])]),
}


@pytest.mark.parametrize("layout", EXPORTS)
def test_layouts(spark, tmp_path, layout):
    file = tmp_path / "bars.csv"
    file.write_text(EXPORTS[layout])
    rows = bars_csv.read_bars_csv(spark, [str(file)], "DAX", "America/New_York").orderBy("ts").collect()
    want = [(pd.Timestamp(f"{d} {t}") + pd.Timedelta("4h"), *p[:4]) for d, t, *p in BARS]
    assert [(pd.Timestamp(r.ts), r.open, r.high, r.low, r.close) for r in rows] == want
    assert [r.volume for r in rows] in ([float(b[-1]) for b in BARS], [None] * 3)
    shown = bars_csv.detect_bar_format(EXPORTS[layout].splitlines()).preview
    assert len(shown) == 3 + (layout != "nothing but rows")


def test_dirty_rows(spark, tmp_path):
    rows = ["when,open,high,low,close,volume", "2022-06-01 09:30,7,9,6,8,11", "2022-06-01 09:30,5,5,5,5,1", "2022-06-01 09:31,8,9,7,7.5", "2022-06-01 09:32,8,9,7,7.5,1,2,3"]
    rows += ["soon,7,9,6,8,11", "2022-06-01 09:33,8,7,9,8,1", "2022-06-01 09:34,8,,7,8,1", "2022-06-01 09:35,8,9,seven,8,1", "", "2022-06-01 09:36,7,9,6,8,"]
    file = tmp_path / "bars.csv"
    file.write_text("\n".join(rows))
    found = bars_csv.read_bars_csv(spark, [str(file)], "A").orderBy("ts").collect()
    assert [(r.ts.minute, r.open, r.volume) for r in found] == [(30, 7.0, 11.0), (31, 8.0, None), (36, 7.0, None)]


def test_files_are_cleaned_one_by_one(spark, tmp_path):
    head = "datetime,open,high,low,close\n"
    (tmp_path / "A_1.csv").write_text(head + "2022-06-01 09:30,5,4,6,5\n2022-06-01 09:31,1,2,0.5,1\n")
    (tmp_path / "A_2.csv").write_text(head + "2022-06-01 09:30,5,6,4,5\n2022-06-01 09:31,3,4,2,3\n2022-06-01 09:32,1,1,1,1\n")
    found = folders.load_symbol_folder(spark, str(tmp_path), "A").orderBy("ts").collect()
    assert [(r.ts.minute, r.high) for r in found] == [(30, 6.0), (31, 2.0), (32, 1.0)]


@pytest.mark.parametrize("text", ["", "words\n", "when;open;high;low;close\n", "red,green,blue\n4,5,6\n", "when,open,high,low,close\nnever,1,2,3,4\nsoon,1,2,3,4\n", "when,open,high\n2022-06-01 09:30,1,2\n"])
def test_files_that_are_no_bars(spark, tmp_path, text):
    (tmp_path / "x.csv").write_text(text)
    with pytest.raises(ValueError, match=r"x\.csv"):
        bars_csv.read_bars_csv(spark, [str(tmp_path / "x.csv")], "X")


def test_dates_that_can_be_read_both_ways(spark, tmp_path):
    lines = lambda *days: ["Day;Open;High;Low;Close", *(f"{d} 14:05;3;4;2;3" for d in days)]
    own = bars_csv.detect_bar_format(lines("03/04/2021", "11/04/2021"))
    assert own.ambiguous_date and own.ts_format == "%d/%m/%Y %H:%M"
    assert not bars_csv.detect_bar_format(lines("03/04/2021", "17/04/2021")).ambiguous_date
    late = bars_csv.detect_bar_format(lines("03/04/2021", "04/17/2021"))
    assert not late.ambiguous_date and late.ts_format == "%m/%d/%Y %H:%M"
    assert not bars_csv.detect_bar_format(lines("2021/03/04")).ambiguous_date
    (tmp_path / "b.csv").write_text("\n".join(lines("03/04/2021")))
    with pytest.warns(UserWarning, match="day or month first"):
        assert bars_csv.sniff(spark, [str(tmp_path / "b.csv")])[str(tmp_path / "b.csv")].ambiguous_date


@pytest.mark.parametrize("tz", ["Europe/Amsterdam", "America/New_York", "Australia/Sydney", "Asia/Tokyo"])
def test_clocks_against_pandas(spark, tz):
    wall = pd.date_range("2024-01-01", "2024-12-31", freq="15min")
    df = spark.createDataFrame(pd.DataFrame({"wall": wall.tz_localize("UTC")}))
    got = df.select("wall", bars_csv.localize_to_utc(F.col("wall"), tz).alias("utc")).toPandas().set_index("wall").utc.sort_index()
    want = pd.Series(wall.tz_localize(tz, ambiguous="NaT", nonexistent="shift_forward").tz_convert("UTC").tz_localize(None), index=wall)
    assert (got.isna().to_numpy() == want.isna().to_numpy()).all() and (got.dropna().to_numpy() == want.dropna().to_numpy()).all()


def test_folder(spark, tmp_path):
    for name, day in (("EURUSD_2019.csv", "2019-01-02"), ("EURUSD_2020.csv", "2020-01-02"), ("eurusd_more.txt", "2021-01-02"), ("GBPUSDM1-x.csv", "2020-05-05"), ("notes.md", "")):
        (tmp_path / name).write_text(f"datetime,open,high,low,close\n{day} 10:00,1,2,0.5,1.5\n")
    assert [r.symbol for r in folders.list_symbols(spark, str(tmp_path)).collect()] == ["EURUSD", "GBPUSD"]
    years = lambda y: sorted(r.ts.year for r in folders.load_symbol_folder(spark, str(tmp_path), "eurusd", years=y).collect())
    assert years(None) == [2019, 2020, 2021] and years((2020, 2020)) == [2020, 2021]
    with pytest.raises(FileNotFoundError):
        folders.load_symbol_folder(spark, str(tmp_path), "XYZ")


def test_parquet_and_fingerprint(spark, tmp_path):
    bars = spark.createDataFrame(pd.concat([walk(2, 1, symbol="A"), walk(2, 2, symbol="B")]))
    tables.write_bars_parquet(bars, str(tmp_path / "bars"))
    back = tables.read_bars_parquet(spark, str(tmp_path / "bars"), ["A"], (2024, 2024))
    assert back.count() == bars.filter("symbol = 'A'").count()
    assert len(back.inputFiles()) == 2 and back.select("symbol").distinct().count() == 1
    prints = dict(tables.dataset_fingerprint(bars).collect())
    assert len(set(prints.values())) == 2 and dict(tables.dataset_fingerprint(back).collect()) == {"A": prints["A"]}


def test_registry(spark, tmp_path):
    events = spark.createDataFrame([(i, i % 3 == 0, i % 2 == 0, float(i % 4) - 1, i) for i in range(30)], "event_id long, win boolean, ambiguous boolean, r_fixed double, bars_held int")
    r, spec = Registry(spark, str(tmp_path / "registry")), Spec(name="one", symbol="NQ")
    assert r.list_studies().count() == 0 and not (tmp_path / "registry").exists() and r.reveal_count(spec.family()).first().level == "none"
    summary = G.summarise(events, 0.2, n_boot=50)
    a = r.append_study(spec, summary, events, "NQ", "abc", "2024-01-01", "2024-02-01")
    b = r.append_study(Spec(name="two", symbol="NQ"), summary, events.limit(5), "NQ", "abc", "2024-01-01", "2024-02-01")
    assert [s.id for s in r.list_studies().collect()] == [b, a] and r.get_study(a).first().n == 30 and r.load_events(b).count() == 5
    assert r.trial_counts().first().asDict() == {"trials": 2, "distinct_trials": 1, "deflated_threshold": 0.0}
    for _ in range(3):
        r.log_reveal(spec, summary, a)
    assert r.reveal_count(spec.family()).first().asDict() == {"looks": 3, "level": "error"} and r.reveal_history(spec.family()).count() == 3
    row = spark.createDataFrame([("", "fvg", "both")], "s string, d string, x string").select(family_key(F.col("s"), F.col("d"), F.col("x"))).first()
    assert row[0] == "*|fvg|both" == Spec(zone=Spec.from_dict({"zone": {"detector": "fvg"}}).zone).family()


@pytest.mark.parametrize("small", [0, 4 << 20])
def test_heads_of_a_file_of_many_pieces(spark, tmp_path, monkeypatch, small):
    """Columns in an order of their own, so that only the header tells them, in a file that is read in many pieces."""
    monkeypatch.setattr(bars_csv, "_SMALL", small)
    rows = [f"{14 + k % 3},{k % 24:02d}:{k % 60:02d} x,{10 + k % 5},{11.5 + k % 5},2021-03-{1 + k // 1440:02d} {k // 60 % 24:02d}:{k % 60:02d},{10.5 + k % 5}" for k in range(4000)]
    (tmp_path / "NQ one.csv").write_text("\n".join(["High,Note,Low,Close,DateTime,Open", *(r.replace(f"{14 + k % 3},", f"{20 + k % 3},", 1) for k, r in enumerate(rows))]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        bars = folders.load_symbol_folder(spark, str(tmp_path), "NQ")
        assert bars.count() == 4000
        assert [tuple(r) for r in bars.agg(F.min("high"), F.max("high"), F.min("low"), F.max("low"), F.min("open"), F.max("close")).collect()] == [(20.0, 22.0, 10.0, 14.0, 10.5, 15.5)]
        assert bars_csv.read_bars_csv(spark, [str(tmp_path)], "NQ").count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_first_row_stays_in_a_file_of_many_pieces(spark, tmp_path):
    rows = [f"2021-03-01 10:{k % 60:02d},{k // 60 + 1},{k // 60 + 2},{k // 60 + 0.5},{k // 60 + 1}" for k in range(1200)]
    (tmp_path / "A.csv").write_text("\n".join(["datetime,open,high,low,close", *rows]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        assert {r.open for r in bars_csv.read_bars_csv(spark, [str(tmp_path / "A.csv")], "A").collect()} == {1.0}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_folder_of_many_symbols_is_one_read_for_each_layout(spark, tmp_path, monkeypatch):
    reads, raw = [], bars_csv._raw
    monkeypatch.setattr(bars_csv, "_raw", lambda *a: reads.append(len(a[2])) or raw(*a))
    for k in range(120):
        day = f"2020-01-{1 + k % 28:02d}"
        (tmp_path / f"S{k:03d}_M1.csv").write_text(f"datetime,open,high,low,close\n{day} 10:00,{k},{k + 2},{k},{k + 1}\n")
        (tmp_path / f"s{k:03d} more 2021.txt").write_text(f"Date;Time;Open;High;Low;Close\n{day.replace('-', '.')};10:0{k % 2};{k},5;{k + 2},5;{k},5;{k + 1},5\n")
    (tmp_path / "S00.csv").write_text("datetime,open,high,low,close\n2020-02-01 10:00,7,7,7,7\n")
    one = sorted(tuple(r) for s in ("S00", "S007") for r in folders.load_symbol_folder(spark, str(tmp_path), s).collect())
    reads.clear()
    bars = folders.load_folder(spark, str(tmp_path))
    assert sorted(reads) == [120, 121]
    rows = [tuple(r) for r in bars.collect()]
    assert len({r[0] for r in rows}) == 121 and sorted(r for r in rows if r[0] in ("S00", "S007")) == one
    assert {r[0]: sum(x[0] == r[0] for x in rows) for r in rows}["S001"] == 2  # 10:00 in one file, 10:01 in the other
    late = folders.load_folder(spark, str(tmp_path), years=(2020, 2020))
    assert late.filter("symbol = 'S001'").count() == 1
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        folders.load_folder(spark, str(tmp_path / "none"))


def test_folder_is_loaded_again_only_where_it_changed(spark, tmp_path, monkeypatch):
    folder, out = tmp_path / "in", str(tmp_path / "bars")
    folder.mkdir()
    lines = lambda *rows: "datetime,open,high,low,close\n" + "".join(f"{t},{p},{p},{p},{p}\n" for t, p in rows)
    (folder / "AA_1.csv").write_text(lines(("2019-05-01 10:00", 1), ("2020-05-01 10:00", 2)))
    (folder / "AA_2.csv").write_text(lines(("2020-05-01 10:00", 3), ("2020-06-01 10:00", 4), ("2021-05-01 10:00", 5)))
    (folder / "AA_3.csv").write_text(lines(("2022-05-01 10:00", 6)))
    (folder / "BB.csv").write_text(lines(("2020-05-01 10:00", 7)))
    parsed, rows = [], folders.read_rows
    monkeypatch.setattr(folders, "read_rows", lambda s, files, *a: parsed.extend(r.path.rsplit("/", 1)[1] for r in files.collect()) or rows(s, files, *a))

    def load():
        parsed.clear()
        n = folders.update_folder(spark, str(folder), out)
        plain = lambda df: sorted(tuple(r) for r in df.collect())
        assert plain(tables.read_bars_parquet(spark, out)) == plain(folders.load_folder(spark, str(folder)))
        return n, sorted(parsed)

    def written():
        return {str(p.relative_to(out)).rsplit("/", 1)[0]: p.name for p in (tmp_path / "bars").rglob("*.parquet") if "symbol=" in str(p)}

    assert load() == (4, ["AA_1.csv", "AA_2.csv", "AA_3.csv", "BB.csv"])
    first = written()
    assert load() == (0, []) and written() == first
    (folder / "AA_1.csv").write_text(lines(("2019-05-01 10:00", 1), ("2020-05-01 10:00", 22)))
    assert load() == (2, ["AA_1.csv", "AA_2.csv"])  # the second has bars of 2020, too
    second = written()
    assert {k for k in first if first[k] != second.get(k)} == {"symbol=AA/year=2019", "symbol=AA/year=2020"}
    (folder / "AA_3.csv").unlink()
    (folder / "BB_more.csv").write_text(lines(("2023-05-01 10:00", 8)))
    assert load() == (1, ["BB_more.csv"])
    assert set(written()) == {"symbol=AA/year=2019", "symbol=AA/year=2020", "symbol=AA/year=2021", "symbol=BB/year=2020", "symbol=BB/year=2023"}
    monkeypatch.setattr(folders, "remove_bars", lambda *a: 1 / 0)
    (folder / "AA_2.csv").unlink()
    with pytest.raises(ZeroDivisionError):
        folders.update_folder(spark, str(folder), out)
    monkeypatch.setattr(folders, "remove_bars", tables.remove_bars)
    assert load()[0] > 0 and load() == (0, [])


@pytest.mark.parametrize("broken", ["events", "studies", "trials", "commits"])
def test_registry_shows_no_study_that_broke_off(spark, tmp_path, monkeypatch, broken):
    from zonestudy.sources import registry

    events = spark.createDataFrame([(i, True, False, 1.0, i) for i in range(25)], "event_id long, win boolean, ambiguous boolean, r_fixed double, bars_held int")
    r, summary = Registry(spark, str(tmp_path / "r")), G.summarise(events, 0.2, n_boot=20)
    own = dict(name="two", symbol="NQ", timeframe="15min")
    kept = r.append_study(Spec(name="one", symbol="NQ"), summary, events, "NQ", "abc", "a", "b")

    def fails(self, table, *a):
        if table == broken:
            raise OSError(table)

    with monkeypatch.context() as m:
        add = Registry._add
        m.setattr(Registry, "_add", lambda self, table, *a: fails(self, table) or add(self, table, *a))
        if broken == "events":
            m.setattr(registry, "write_events", lambda *a: fails(r, "events"))
        m.setattr(registry.uuid, "uuid4", lambda: type("U", (), {"hex": "lost"}))
        with pytest.raises(OSError):
            r.append_study(Spec(**own), summary, events, "NQ", "abc", "a", "b")
    assert [s.id for s in r.list_studies().collect()] == [kept] and r.get_study("lost").count() == 0
    assert r.trial_counts().first().trials == 1 and not r.threshold_applies()
    with pytest.raises(KeyError):
        r.load_events("lost")
    r.append_study(Spec(**own), summary, events, "NQ", "abc", "a", "b")
    assert r.list_studies().count() == 2 and r.trial_counts().first().distinct_trials == 2
