"""The entry point, with and without the subpackage of text operators, and some queries against their SQL."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_name_and_most_have_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {n for n in entry.queries() if n[:2] != "op" and n != "pipeline"} <= set(entry.oracle_sql())


def test_without_the_text_operators():
    code = "import sys; sys.modules['zonestudy.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 40 and not any(n.startswith('op') for n in e.queries()); print('ok')"
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "ok", done.stderr


@pytest.mark.parametrize("name", ["b1_resample_anchored", "f12_features", "f10_swing_points", "z4_prior_session_level", "j3_separate_tests", "e1_e2_e4_scan", "g7_excursion_histogram"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    plain = lambda v: None if v is None else round(v, 5) if isinstance(v, float) else v
    want = sorted((tuple(plain(v) for v in r) for r in found.fetchall()), key=str)
    got = sorted((tuple(plain(v) for v in r) for r in entry.queries()[name](spark, DATA).select(*names).collect()), key=str)
    assert got == want


def test_outcomes_against_sql(spark):
    test_against_sql(spark, "p7_filter_outcome")


def test_baselines_against_sql(spark):
    test_against_sql(spark, "g2_g12_baseline_table")


def both(spark, folder, name, part):
    """The rows of a query and those of its SQL over a part of the events, to all six places; NaN isn't null."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"COPY (SELECT * FROM '{DATA}/events.parquet' WHERE {part}) TO '{folder}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    exact = lambda rows: sorted(tuple(map(repr, r)) for r in rows)
    return exact(entry.queries()[name](spark, str(folder)).select(*names).collect()), exact(found.fetchall())


def test_counts_against_sql(spark, tmp_path):
    """Three of five symbols have zones."""
    got, want = both(spark, tmp_path, "e5_scan_counts", "event_id < 75")
    assert got == want and len(got) == 3


@pytest.mark.parametrize("part", ["event_id < 50", "event_id < 72"])
def test_summary_against_sql(spark, tmp_path, part):
    """No events, and a single one, whose mean is both of its bounds."""
    got, want = both(spark, tmp_path, "g1_g4_summary", part)
    assert got == want


@pytest.mark.parametrize("part", ["event_type = 'click'", "event_id < 75", "event_id < 50"])
def test_splits_against_sql(spark, tmp_path, part):
    """Rates whose difference depends on the rounding, no events in one part, and none in both."""
    got, want = both(spark, tmp_path, "g11_compare_splits", part)
    assert got == want


@pytest.mark.parametrize("name", ["s1_s5_csv_bars", "s6_s7_symbol_folder"])
def test_csv_queries_read_back_every_symbol(spark, monkeypatch, name):
    from zonestudy.plans import queries as plans
    from zonestudy.sources import bars_csv

    made, read = [], bars_csv.clean_bars
    monkeypatch.setattr(bars_csv, "clean_bars", lambda *a: made.append(read(*a)) or made[-1])
    test_against_sql(spark, name)
    plain = lambda df: sorted((r.symbol.lower(), r.ts, *(round(r[c], 6) for c in ("open", "high", "low", "close", "volume"))) for r in df.collect())
    assert sorted(r for df in made for r in plain(df)) == plain(plans.base(spark, DATA))
