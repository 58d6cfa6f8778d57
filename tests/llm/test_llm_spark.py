"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns; against brute force."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from zonestudy.llm import bitpack, chat, components, decontaminate, licenses, ngram_join, pieces, sharding, toxicity, url_filter, vptree

DOCS = "doc_id long, text string, lang string, score double, shard int, node long"  # names that the operators use, too
LONG = " ".join(f"word{i % 977} x{i}" for i in range(30_000))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 0.5, 3, 9) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    base = [f"t{i}" for i in range(60)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, "one two"), (5, "one two"), (None, "null id text"), (6, "ONE two"), (7, "one  two three")]
    rows += [(10 + k, " ".join(base[:k] + [f"new{k}"] + base[k + 1 :])) for k in range(0, 60, 6)] + [(30, " ".join(base)), (31, " ".join(base).upper())]
    return table(spark, rows)


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else [])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(a)] = root(b)
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if root(j) == root(k) and sets[j][0] is not None]
        out.append((i, len(s), (min(ids) if ids else None) if s else i))
    return sorted(out, key=str)


def test_join_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in ngram_join.join_documents(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == brute_components(rows)


@pytest.mark.parametrize("small", [False, True])
def test_join_of_random_near_copies(spark, monkeypatch, small):
    if small:  # many parts of shingles, hot keys, salted lists and further turns of pivots on a small table
        for module, name, value in ((ngram_join, "PART", 64), (ngram_join, "OPEN", 0), (ngram_join, "LIST", 3), (ngram_join, "FREQUENT", 5), (components, "HOT", 2), (components, "BROADCAST", 3)):
            monkeypatch.setattr(module, name, value)
    rng = np.random.default_rng(2)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.integers(0, 10**6)}" for _ in range(int(rng.integers(5, 70)))]
        for _ in range(8):
            text = list(base)
            for _ in range(int(rng.integers(0, 4))):
                text[int(rng.integers(0, len(text)))] = f"m{rng.integers(0, 10**6)}"
            if rng.random() < 0.3:
                text += [f"tail{i}" for i in range(int(rng.integers(1, 12)))]
            rows.append((len(rows), " ".join(text)))
    got = [tuple(r) for r in ngram_join.join_documents(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == brute_components(rows)


def test_unlinked_sets_of_one_list_are_compared_part_by_part(spark, monkeypatch):
    """400 sets share their first shingle but link only in pairs; whatever the parts of their list, no link is lost."""
    rng = np.random.default_rng(4)
    lists, held = [], {}
    for k in range(200):
        own = np.sort(rng.choice(1 << 40, 40, replace=False))
        for node in (2 * k, 2 * k + 1):
            held[node] = sorted({1, *own[: 39 - (node % 2)].tolist()})
            lists += [(1, node % 7, 7, node, len(held[node]), 0), (2 + k % 3, 0, 1, node, len(held[node]), 0)]
    sets = spark.createDataFrame([(n, len(h), h) for n, h in held.items()], "node long, n int, held array<long>")
    lists = spark.createDataFrame(lists, "key long, salt int, salts int, node long, n int, pos int")
    for turns in (1, 8):
        monkeypatch.setattr(ngram_join, "TURNS", turns)
        got = {r.node: r.component for r in ngram_join._reached(lists, sets).collect()}
        assert got == {n: n - n % 2 for n in held}


@pytest.mark.parametrize("long", [2, 16])
def test_join_when_lists_are_salted(spark, monkeypatch, long):
    """Pairs whose shingles are common, so that their short lists are salted and the two may have different salts."""
    monkeypatch.setattr(ngram_join, "LIST", long)
    rows = []
    for g in range(24):
        ws = [f"g{g}w{i}" for i in range(8)]
        rows += [(len(rows), " ".join(ws[:7])), (len(rows) + 1, " ".join(ws))]
        for k in range(144):
            rows.append((len(rows), " ".join([*ws[k % 3 : k % 3 + 5], f"g{g}k{k}"])))
    got = [tuple(r) for r in ngram_join.join_documents(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()]
    linked = {r[0] for r in got if r[0] != r[2]}
    assert linked == {146 * g + 1 for g in range(24)}
    few = [r for r in rows if r[0] % 146 < 6]
    assert sorted((r for r in got if r[0] % 146 < 6), key=str) == brute_components(few)


def test_join_through_a_text_with_a_null_id(spark):
    ws = [f"t{i}" for i in range(44)]
    rows = [(1, " ".join(ws[:30])), (2, " ".join(ws[4:])), (None, " ".join(ws[:38])), (None, " ".join(ws[:38])), (3, "on its own"), (None, "alone too")]
    got = [tuple(r) for r in ngram_join.join_documents(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == brute_components(rows)
    assert {r[0]: r[2] for r in got if r[1] > 20} == {1: 1, 2: 1, None: 1}


def test_first_of_each_keeps_columns(spark, docs):
    kept = ngram_join.first_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    want = sorted((i for i, _, c in brute_components([(r.doc_id, r.text) for r in docs.collect()]) if i is None or i == c), key=str)
    assert ids == want


def test_first_of_each_goes_by_text(spark):
    """Rows of one id whose texts differ, null ids beside ids, and null ids only."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    near = c.replace("c7 ", "new ")
    rows = [(1, a), (5, a), (5, b), (None, a), (None, c), (None, c), (None, near), (None, "alone"), (None, None), (None, None), (None, ""), (7, d), (7, d), (None, "two two"), (None, "two two")]
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.first_of_each(table(spark, rows)).collect()), key=str)
    left = [r for r in kept if r[1] in (c, near)]
    assert len(left) == 1 and left[0][0] is None
    assert [r for r in kept if r[1] not in (c, near)] == sorted([(1, a), (5, b), (None, "alone"), (None, None), (None, None), (None, ""), (7, d), (7, d), (None, "two two")], key=str)


@pytest.mark.parametrize("block_bytes", [1, 40, 1 << 20])
def test_templates_of_one_name(spark, block_bytes):
    """Each text of a name is sought, in blocks of any size; equal rows are one template."""
    names = [("X", "one two three four"), ("X", "five six seven eight"), ("X", "five six seven eight"), (None, "nine ten eleven twelve"), ("Y", "one two three four")]
    own = spark.createDataFrame(names, "license string, text string")
    docs = table(spark, [(1, "see one two three four there"), (2, "five six seven eight"), (3, "nine ten eleven twelve"), (4, "none")])
    found = sorted(((r.doc_id, r.license) for r in licenses.scan(docs, own, block_bytes=block_bytes).collect()), key=str)
    assert found == [(1, "X"), (1, "Y"), (2, "X"), (3, None)]


def test_empty_tables(spark):
    none = table(spark, [])
    assert ngram_join.join_documents(none).count() == 0
    assert sharding.shard_documents(none).count() == 0
    assert licenses.scan(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_overlaps(none, items).count() == 0
    assert decontaminate.without_overlaps(table(spark, [(1, "a")]), items).count() == 1
    model = toxicity.train(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score_documents(none, model).count() == 0
    assert pieces.encode_documents(none, str(public_tokenizers.path("piece_bpe_32k.model"))).count() == 0
    assert bitpack.encode_documents(none, str(public_tokenizers.path("word_bpe_49k.json"))).count() == 0
    assert vptree.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), _every()).count() == 0
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.chat_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 1


def _every():
    from pyspark.sql import functions as F

    return F.col("vec_id") % 20 == 0


def test_shards(spark, docs):
    rows = sharding.shard_documents(docs, 4).collect()
    assert len(rows) == docs.count()
    sizes = {r.doc_id: len((r.text or "").encode()) + 1 for r in docs.collect()}
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    for s in range(4):
        own = sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 4) <= largest
    for r in rows:
        assert r.size == sizes[r.doc_id] and r.grown_shard is None and r.law == "bytes"
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    assert {r.text_crc32 for r in rows if r.doc_id in (1, 2)} == {0}


def test_shards_of_whole_rows(spark, docs, tmp_path):
    clashing = docs.drop("shard").toDF("doc_id", "text", "_total", "_size", "part").selectExpr("*", "1 AS row", "2 AS tie", "3 AS first", "4 AS `a.b`")
    sharding.write_shards(clashing, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == sorted([*clashing.columns, "shard", "slot"])
    assert sorted(map(str, back.select(*[f"`{c}`" for c in clashing.columns]).collect())) == sorted(map(str, clashing.collect()))
    order = [r.doc_id for r in back.orderBy("shard", "slot").collect()]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    with pytest.raises(ValueError, match="shard"):
        sharding.write_shards(docs, str(tmp_path / "none"), 3)


def test_shards_against_plain_sums(spark):
    rows = [(i % 37, "x" * ((i * 7919) % 53)) for i in range(500)] + [(5, None), (None, "n")]
    got = sorted(sharding.shard_documents(table(spark, rows), 5).collect(), key=lambda r: (r.shard, r.slot))
    want = sorted(((i, len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[2], x[1]))
    total, at, shards = sum(x[1] for x in want), 0, []
    for _, size, _ in want:
        shards.append(min(4, (2 * at + size) * 5 // (2 * total)))
        at += size
    assert [(r.doc_id, r.size, r.text_crc32, r.shard) for r in got] == [(*x, s) for x, s in zip(want, shards)]


def test_token_files(spark, docs, tmp_path):
    file, path = str(public_tokenizers.path("word_bpe_49k.json")), str(tmp_path / "ids")
    encoder = bitpack.WordEncoder(file)
    bitpack.write_ids(docs, path, file, 2, block_ids=500)
    blocks = bitpack.read_blocks(spark, path)
    got = sorted(bitpack.id_digests(blocks).collect(), key=lambda r: r.start)
    at = 0
    want = sorted(((r.doc_id, encoder(pa.array([r.text], pa.string()))[0] + np.array([2], dtype="<u4").tobytes()) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    held = {i: b for i, b in want}
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(held[r.doc_id]) // 4, zlib.crc32(held[r.doc_id]))
        at += r.n_tokens
    some = bitpack.read_ids(blocks, [30, 4, 999]).collect()
    assert {r.doc_id: np.array(r.ids, dtype="<u4").tobytes() for r in some} == {i: held[i] for i in (4, 30)}
    assert bitpack.read_ids(blocks).count() == docs.count() and bitpack.read_ids(blocks, []).count() == 0
    assert {b.bits for b in blocks.collect()} == {16} and blocks.count() > 5


def test_pieces(spark, docs):
    file = str(public_tokenizers.path("piece_bpe_32k.model"))
    rows = pieces.encode_documents(docs, file).collect()
    again = {(r.doc_id, r.decoded_crc32): r.ids for r in pieces.encode_documents(docs.repartition(7), file).collect()}
    texts = {(r.doc_id, zlib.crc32((r.text or "").encode())) for r in docs.collect()}
    assert {(r.doc_id, r.decoded_crc32) for r in rows} == texts
    assert all(r.lossless and r.n_ids == len(r.ids) and again[r.doc_id, r.decoded_crc32] == r.ids for r in rows)


def test_neighbours_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(700, 8)).astype(np.float32)
    v[300:420] = v[300]
    v[5] *= 7
    rows = [(i, [float(x) for x in v[i]], 1) for i in range(700)]
    bad = [(2000, None, 1), (2020, [], 1), (2040, [0.0] * 8, 1), (2060, [1.0, None] * 4, 1), (2080, [float("nan")] * 8, 1), (None, [1.0] * 8, 1), (2100, [float("inf")] * 8, 1), (40, rows[40][1], 1)]
    table_ = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in vptree.nearest(table_, _every(), 20, 1.0, shard_rows=200, query_rows=16).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert sorted(got) == list(range(0, 700, 20))
    for q, found in got.items():
        s = vptree.inner_products(np.repeat(v[q : q + 1], 700, axis=0), v)
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:20]
        assert [found[k] for k in range(1, 21)] == [(i, s[i]) for i in order]
    monkeypatch.setattr(vptree, "SHARDS", 1)
    by_ones = vptree.nearest(table_, _every(), 20, 1.0, shard_rows=40, query_rows=16).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in by_ones} == {(q, k): x for q, found in got.items() for k, x in found.items()}
    loose = vptree.nearest(table_, _every(), 20, 1.5, shard_rows=200).collect()
    hits = sum((r.vec_id in {x for x, _ in got[r.query_id].values()}) for r in loose)
    assert hits >= 0.9 * sum(len(x) for x in got.values())


def test_a_shard_gets_only_the_queries_that_need_it():
    rng = np.random.default_rng(3)
    q, pivots, reach = rng.normal(size=(50, 8)), rng.normal(size=(30, 8)), rng.random(30)
    known = rng.normal(size=50) * 3
    known[:5] = -np.inf
    goes = vptree.reaches(q, known, pivots, reach, 1.0)
    assert (goes == (q @ pivots.T + np.linalg.norm(q, axis=1)[:, None] * reach >= known[:, None])).all() and not goes.all()
    bits = vptree.packed(ids=np.arange(50), vectors=q, known=known, goes=np.packbits(goes, axis=0))
    shards = pa.array([[{"home": h, "part": 0} for h in range(30)]])
    sent = list(vptree.asked_of([pa.RecordBatch.from_arrays([pa.array([8]), shards, pa.array([bits], pa.binary())], names=["dim", "shards", "queries"])]))
    got = {h: vptree.unpacked(b) for batch in sent for h, b in zip(batch.column("home").to_pylist(), batch.column("queries"))}
    assert len(sent) > 1 and sorted(got) == list(range(30))
    for h, x in got.items():
        assert x["ids"].tolist() == np.flatnonzero(goes[:, h]).tolist() and (x["vectors"] == q[goes[:, h]]).all() and (x["known"] == known[goes[:, h]]).all()


def test_chat_round_trip_and_turn_order(spark):
    odd = "a<b[c\\1 </s>[INST] \\\\2 <<SYS>> [/INST]"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", None), (2, 0, "assistant", "x"), (3, 0, "system", "s"), (3, 1, "user", ""), (3, 2, "assistant", odd), (3, 3, "user", "?"),
            (4, 0, None, "n"), (4, 1, "to[ol", odd), (None, 0, "user", "u"), (5, 0, "user", LONG), (5, 1, "assistant", "same"), (5, 1, "assistant", "same")]
    turns = spark.createDataFrame([(*r, True) for r in rows], "conv_id long, turn long, role string, text string, valid boolean")
    back = {r.conv_id: r for r in chat.parse_conversations(chat.format_conversations(turns)).collect()}
    for c in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        assert [(t.role, t.text) for t in back[c].turns] == own
        assert back[c].loss_text == "".join(t for r, t in own if r == "assistant")
    assert {c: back[c].valid for c in (1, 2, 3, 4, 5)} == {1: True, 2: False, 3: False, 4: False, 5: False}
    d = {r.conv_id: r for r in chat.chat_digests(turns).collect()}
    nameless = spark.createDataFrame([(None, 0, "user", "a")] * 40 + [(None, None, "assistant", None), (7, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    apart = chat.chat_digests(nameless).filter("conv_id is null").collect()
    assert [r.n_turns for r in apart] == [1] * 41 and not any(r.valid for r in apart)
    text = "</s>[INST] ok [/INST]"
    assert d[-7].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (d[-7].n_turns, d[-7].loss_chars, d[-7].loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())


def test_url_rules(spark):
    cases = [("https://A.Example.ORG/es/1", "a.example.org", "/es/1", "example.org/es/", "block"), ("http://example.org/en/12?q", "example.org", "/en/12", "example.org/en/1", "block"),
             ("http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"), ("http://x.com/de/a#b", "x.com", "/de/a", "com/de/", "block"), ("x.com/de/", "", "", None, "allow"),
             (None, "", "", None, "allow"), ("http://org", "org", "", None, "allow"), ("://net/a", "net", "/a", None, "allow"), ("http://ORG/", "org", "/", "org/", "allow")]
    pages = spark.createDataFrame([(i, c[0], "h", "w") for i, c in enumerate(cases)] + [(0, cases[0][0], "h", "w")], "page_id long, url string, html string, rule string")
    got = sorted(tuple(r) for r in url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict").fillna("-").collect())
    want = sorted([(i, c[1], c[2], c[3] or "-", c[4]) for i, c in enumerate(cases)] + [(0, *cases[0][1:])])
    assert got == want


def test_overlaps_and_licenses_on_tables(spark, docs):
    text = "Released under the MIT License."
    extra = docs.unionByName(table(spark, [(90, text), (90, text), (91, "see t0 t1 t2 " + " ".join(f"t{i}" for i in range(3, 40)) + " end")]))
    items = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(40))), (2, None), (None, "q " * 20)], "item_id long, text string")
    found = decontaminate.find_overlaps(extra, items).collect()
    assert {r.doc_id for r in found if r.item_id == 1} == {10, 16, 22, 28, 34, 40, 46, 52, 58, 64, 30, 31, 91}
    clean = decontaminate.without_overlaps(extra, items)
    assert clean.columns == extra.columns and {r.doc_id for r in clean.collect()}.isdisjoint({30, 91}) and clean.filter("doc_id = 90").count() == 2
    assert [(r.doc_id, r.license) for r in licenses.scan(extra).collect()] == [(90, "MIT")] * 2
    own = spark.createDataFrame([("short", "mit license", 1), ("none", None, 1), ("long", " ".join(f"t{i}" for i in range(50)), 1)], "license string, text string, doc_id int")
    found = licenses.scan(extra, own, block_bytes=5).collect()
    assert sorted({(r.doc_id, r.license) for r in found}) == sorted([(90, "short"), *((i, "long") for i in (10, 16, 22, 28, 34, 40, 46, 52, 58, 64, 30, 31, 91))])
    assert licenses.scan(extra, own.limit(0)).count() == 0


def test_toxicity_on_tables(spark):
    good = [(i, f"word{i % 7} is here. all {i % 11} fine words{i % 5}.") for i in range(300)]
    rows = [(i, t + f" you are scum{i % 3}x." if i % 4 == 0 else t) for i, t in good] + [(400, None), (401, ""), (None, "You are SCUM0X.")]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    out = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    for i, _ in good:
        assert out[i].predicted == int(i % 4 == 0) and out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert out[400].score == out[401].score < 0.7
    assert {r.doc_id for r in toxicity.without_toxic(docs, model).collect()} == {i for i, _ in good if i % 4} | {400, 401}


def test_toxicity_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_documents(docs, toxicity.train(docs, labels)).filter("held_out").join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id")
    rows = scored.select("toxic", "predicted", "offending", "text", "n_sentences").collect()
    caught, toxic, called = sum(r.toxic and r.predicted for r in rows), sum(r.toxic for r in rows), sum(r.predicted for r in rows)
    assert toxic > 100 and caught >= 0.8 * toxic and caught >= 0.9 * called
    for r in rows:
        size = len((r.text or "").encode())
        assert all(0 <= x.start < x.end <= size and x.score > 0.5 for x in r.offending) and len(r.offending) <= r.n_sentences
        assert r.offending or not r.predicted


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}


def test_pipeline_against_its_operators(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    left = [(r.doc_id, r.text) for r in docs.collect()]
    toxic = {r.doc_id for r in toxicity.score_documents(docs, model).collect() if r.predicted}
    left = [(i, t) for i, t in left if i not in toxic]
    first = {i for i, _, c in brute_components(left) if i == c}
    left = [(i, t) for i, t in left if i in first]
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    dirty = {r.doc_id for r in decontaminate.find_overlaps(docs, items).collect()}
    want = {i: zlib.crc32((t or "").encode()) for i, t in left if i not in dirty}
    assert {r.doc_id: r.decoded_crc32 for r in corpus_pipeline.run(spark, d).collect()} == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "sentencepiece"]
