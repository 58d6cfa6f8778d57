"""Manifest, periodic runs and near-duplicate vectors against brute force, on odd tables too."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from zonestudy.llm import capfilter, merkle, runs

DOCS = "doc_id long, text string, lang string, source string, n_chars int, pos long, tree string, task int, path string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def docs_table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, n, 7, "x", 1, "p") for i, t, lang, source, n in rows], DOCS)


def fold_up(leaves):
    """Levels of a tree, from the leaves to its root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][a : a + 16])) for a in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        first = at - at % 16
        out.append((level[first:at], level[at + 1 : first + 16]))
        at //= 16
    return out


def brute_manifest(rows):
    def leaf(i, source, lang, n, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))

    groups = defaultdict(list)
    for i, t, lang, source, n in rows:
        forged = t if t is None or i is None or zlib.crc32(str(i).encode()) % 5 else "".join(c.lower() if c.isascii() else c for c in t)
        groups[source].append((i, leaf(i, source, lang, n, t), leaf(i, source, lang, n, forged)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: fold_up([x[1] for x in sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s in order}
    top = fold_up([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, (i, own, forged) in enumerate(sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            path = siblings(trees[s], at) + siblings(top, k)
            folded = forged
            for left, right in path:
                folded = sha("".join([*left, folded, *right]))
            proof = sha("".join("".join(left + right) for left, right in path))
            out.append((i, own, trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def odd_documents():
    rows = [(1, None, None, None, None), (2, "", "en", "", 0), (3, "ABC Ä", "de", "é", 3), (3, "ABC Ä", "de", "é", 3), (None, "NO id", "en", "hot", 5), (None, None, "en", "hot", None), (4, "Long " * 30_000, "en", "one", 1)]
    rows += [(i, f"Text {i} OF the hot source", "en", "hot", i) for i in range(10, 810)]
    return rows + [(i, f"Text {i}", "fr", f"s{i % 19:02d}", None) for i in range(1000, 1200)]


def manifest_rows(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_manifest_against_brute_force(spark):
    rows = odd_documents()
    got = manifest_rows(merkle.manifest_documents(docs_table(spark, rows)))
    want = brute_manifest(rows)
    assert got == want
    assert {r[6] for r in got} == {True, False}


def test_manifest_with_many_sweeps_and_cuts(spark, monkeypatch):
    """So few messages in a task that sweep follows sweep, and leaves cut anywhere."""
    monkeypatch.setattr(merkle, "MESSAGES", 60)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        swept, build = [], merkle.build_up
        monkeypatch.setattr(merkle, "build_up", lambda x: swept.append(build(x)) or swept[-1])
        rows = odd_documents()
        assert manifest_rows(merkle.manifest_documents(docs_table(spark, rows))) == brute_manifest(rows)
        assert len(swept[0][0]) >= 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("rows", [[], [(5, "A", "en", "x", 1)], [(5, "A", "en", "x", 1), (6, "b", "en", None, 1)]])
def test_manifest_of_few_rows(spark, rows):
    assert manifest_rows(merkle.manifest_documents(docs_table(spark, rows))) == brute_manifest(rows)


def brute_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - a >= q and i - a + q >= least:
                found.setdefault((a, i - a + q), q)
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda x: (x[0], x[2]))


def test_lyndon_words_and_runs_against_brute_force():
    rng = random.Random(3)
    for turn in range(400):
        s = [rng.choice([*range(1, rng.choice((2, 3, 6)))] * 4 + [0] * (turn % 2)) for _ in range(rng.randint(1, 40))]
        lyndon = [next((n for n in range(len(s) - i, 0, -1) if 0 not in s[i : i + n] and all(s[i : i + n] < s[i + k : i + n] for k in range(1, n))), 0) for i in range(len(s))]
        assert runs.lyndon_lengths(np.array(s)).tolist() == lyndon
        cut = [-k if x == 0 else x for k, x in enumerate(s, 1)]  # separators differ
        for least in (2, 12):
            assert [tuple(r) for r in runs.maximal_runs(np.array(s), least).tolist()] == brute_runs(cut, least)


def test_runs_of_long_periodic_words():
    a, b = [1], [2]
    for _ in range(16):
        a, b = b, a + b  # Fibonacci words have as many runs as any
    assert [tuple(r) for r in runs.maximal_runs(np.array(b[:1500])).tolist()] == brute_runs(b[:1500])


def brute_digests(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if i is not None and words and (h := zlib.crc32(str(i).encode())) % 10 == 0:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (k - a) % p] if k >= a else w for k, w in enumerate(words)]
    found = brute_runs(words)
    gone = {k for a, n, q in found for k in range(a + q, a + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (i, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_run_digests_of_odd_rows(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(9)]
    texts = [None, "", " \t\n", "one two", "x " * 3000, "a b c d e f " * 2, "A a " * 8, "ä ö ü " * 9, "\x0bx\x0cy " * 7]
    texts += [" ".join(rng.choice(base) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    texts += [" ".join([*(f"u{k}" for k in range(n)), *base * 3, *(f"v{k}" for k in range(n)), *base[:4] * 4]) for n in (0, 1, 5, 40)]
    rows = [(k, t) for k, t in enumerate(texts * 6)] + [(3, "one two"), (None, "p q r " * 6), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, [2], "c") for i, t in rows], "doc_id long, text string, id long, runs array<int>, collapsed string")
    got = sorted((tuple(r) for r in runs.run_digests(docs).collect()), key=str)
    assert got == sorted((brute_digests(*r) for r in rows), key=str)
    assert runs.run_digests(docs.limit(0)).count() == 0


def test_collapsed_text_and_spans(spark):
    docs = spark.createDataFrame([(1, "head " + "p q r " * 5 + "tail")], "doc_id long, text string")
    row = runs.periodic_runs(docs).first()
    assert [tuple(r) for r in row.runs] == [(1, 15, 3)] and row.collapsed == "head p q r tail"


def test_runs_in_a_long_text_beside_others(spark):
    long = " ".join(f"w{k} x{k * k % 977}" for k in range(60_000))
    repeated = " ".join(f"y{k}" for k in range(5000))
    docs = spark.createDataFrame([(1, long), (2, f"{repeated} {repeated} z"), (3, "q " * 200_000)], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in runs.periodic_runs(docs).collect()}
    assert got[1] == [(a, n, q) for a, n, q in got[1] if n >= 2 * q] and got[2] == [(0, 10_000, 5000)] and got[3] == [(0, 200_000, 1)]


VECTORS = "vec_id long, embedding array<float>, label int, node long, many int, h1 long"


def brute_vectors(rows, cosine=0.93):
    def usable(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    some = [k for k, (_, v, label) in enumerate(rows) if usable(v, label)]
    x = {k: np.array(rows[k][1], dtype=np.float32).astype(float) for k in some}
    links = {k: [j for j in some if j != k and rows[j][2] == rows[k][2] and len(x[j]) == len(x[k]) and x[k] @ x[j] / np.sqrt((x[k] @ x[k]) * (x[j] @ x[j])) >= cosine] for k in some}
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            todo = [j for t in todo for j in links.get(t, ()) if j not in seen and not seen.add(j)]
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((i, len(links.get(k, ())), least, i is not None and i == least))
    return sorted(out, key=str)


def vectors_table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, 3) for i, v, label in rows], VECTORS)


def near_rows(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def clusters(rng, n, size, spread, dim=24):
    centres = rng.standard_normal((n, dim))
    return [(c + spread * np.linalg.norm(c) / np.sqrt(dim) * rng.standard_normal(dim)).tolist() for c in centres for _ in range(size)]


def test_near_vectors_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(k, v, k % 3) for k, v in enumerate(clusters(rng, 40, 6, 0.2))]
    one = rows[0][1]
    rows += [(500, None, 0), (501, [], 0), (502, [0.0] * 24, 0), (503, [float("nan")] * 24, 0), (504, [None, *one[1:]], 0), (505, [float("inf"), *one[1:]], 0), (506, one, None)]
    rows += [(507, one, 0), (507, one, 0), (None, one, 0), (None, rows[1][1], 1), (508, [x * 1e-30 for x in one], 0), (509, [x * 1e30 for x in one], 0), (510, one, 1), (511, [-x for x in one], 0)]
    rows += [(600, [1.0], 0), (601, [2.0], 0), (602, [-1.0], 0), (603, [1.0, 0.1], 0), (604, [1.0, 0.0], 0), (605, [0.0, 1.0], 0), (700 + 3, [5.0, 1.0], 2), (None, [1.0, 9.0], 2)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert near_rows(capfilter.near_duplicates(vectors_table(spark, rows))) == brute_vectors(rows)
    assert capfilter.near_duplicates(vectors_table(spark, rows).limit(0)).count() == 0


def test_near_vectors_met_in_blocks(spark, monkeypatch):
    """A cluster larger than a block, chains that only links of two blocks close, and a vector that a third of all rows have."""
    monkeypatch.setattr(capfilter, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = [(1000 - k, v, 1) for k, v in enumerate(clusters(rng, 1, 150, 0.15) + clusters(rng, 12, 8, 0.26))]
    rows += [(2000 + k, rows[0][1], 1) for k in range(120)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert near_rows(capfilter.near_duplicates(vectors_table(spark, rows))) == brute_vectors(rows)


def test_recall_of_pairs_just_above_the_bound(spark):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    o = rng.standard_normal((1500, 64))
    o -= (o * a).sum(axis=1)[:, None] * a
    o /= np.linalg.norm(o, axis=1)[:, None]
    b = 0.932 * a + np.sqrt(1 - 0.932**2) * o
    rows = [(k, v.tolist(), 0) for k, v in enumerate(np.concatenate([a, b]))]
    got = capfilter.near_duplicates(vectors_table(spark, rows))
    assert got.agg({"n_links": "sum"}).first()[0] >= 0.995 * 3000


def test_filters_grow_with_the_table():
    """About one other vector passes a filter, whatever the table, until the codes are full; and what pairs share stays."""
    for n in (1000, 100_000, 10_000_000):
        f = capfilter.filters_for(64, n)
        share, both = capfilter.shared_share(f.least, 64, capfilter.COSINE)
        assert 0.9 * capfilter.COMMON < capfilter.CODES * f.side**2 * share * both < 1.1 * capfilter.COMMON
        assert share * n < 1.2 or f.side == capfilter.SIDE
