"""Each stage of the pipeline on odd tables: nulls, empty and long texts, ties, repeated rows, no rows, extra columns with clashing names."""

import zlib

import pytest

import corpus_pipeline

D = "/root/testdata/sf0.001"
#: Names that the operators use themselves.
EXTRA = ("n", "node", "half", "more", "shared", "row", "hits", "id", "gone_id", "text_hash", "score", "part", "slice", "label", "key", "many", "component", "item_id", "ids")
LONG = " ".join(f"word{i % 977} x{i}" for i in range(30_000))


def table(spark, rows):
    return spark.createDataFrame([(i, t, *range(len(EXTRA))) for i, t in rows], f"doc_id long, text string, {', '.join(f'{c} long' for c in EXTRA)}")


@pytest.fixture(scope="module")
def odd(spark):
    passage = spark.read.parquet(f"{D}/benchmark.parquet").first().text
    base = [f"t{i}" for i in range(60)]
    near = " ".join([*base[:30], "new", *base[31:]])
    return [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, "one two"), (5, "one two"), (None, "null id"), (None, None), (6, f"see {passage} here"), (7, " ".join(base)), (8, near), (8, near), (9, near.upper())]


def test_stages_on_odd_rows(spark, odd):
    docs = table(spark, odd)
    toxicity, join, decontamination, pieces = (f for _, f in corpus_pipeline.STAGES)
    left = {"toxicity": odd, "join": [r for r in odd if r[0] not in (8, 9)], "decontamination": [r for r in odd if r[0] != 6]}
    for name, stage in (("toxicity", toxicity), ("join", join), ("decontamination", decontamination)):
        out = stage(spark, docs, D)
        assert out.columns == docs.columns, name
        assert sorted(map(str, out.collect())) == sorted(map(str, table(spark, left[name]).collect())), name
    out = pieces(spark, docs, D)
    assert sorted(((r.doc_id, r.decoded_crc32) for r in out.collect()), key=str) == sorted(((i, zlib.crc32((t or "").encode())) for i, t in odd), key=str)
    assert out.filter("not lossless").count() == 0


def test_stages_on_no_rows(spark):
    none = table(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, D)
        assert out.count() == 0, name
        assert name == "sentencepiece" or out.columns == none.columns
