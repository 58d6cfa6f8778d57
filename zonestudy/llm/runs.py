"""Periodic runs of words: Lyndon roots by grouping suffixes under both orders, extended to whole runs by longest common extensions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonestudy.llm.crc import crc32_sql
from zonestudy.llm.shared import slices
from zonestudy.llm.words import SPACES, mix, text_bytes, tokenize, windows

#: Words of the shortest run that counts; every word of such a run is in a stretch of half as many that occurs twice in its text.
LEAST = 12
_RUNS = "array<struct<start: long, length: long, period: long>>"


def lyndon_lengths(ids: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each place; 0 is a separator, which no word crosses.

    The first phase of a suffix sorter: suffixes start in groups by their first word, and groups are taken from the largest down. The nearest
    place before a member whose group is still smaller ends where the member begins: it takes on the group's word, as often as
    members follow it in a row, and moves to a group of its own right above the one it was in. A group's word, when its turn comes, is the
    longest Lyndon word at its members. Each place is a member once, and each member moves one place, so time is linear."""
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.diff(ids[order], prepend=-1))
    sizes = np.diff(np.append(first, len(ids)))
    start_of, place_of = np.empty_like(order), np.empty_like(order)
    start_of[order], place_of[order] = np.repeat(first, sizes), np.arange(len(ids))
    # a group is known by its first place in ``suffixes``; its members' contexts have ``length`` words
    suffixes, group, place, before = order.tolist(), start_of.tolist(), place_of.tolist(), [-1] * len(ids)
    size, length, out = [0] * len(ids), [1] * len(ids), [0] * len(ids)
    for g, k in zip(first.tolist(), sizes.tolist(), strict=True):
        size[g] = k
    end, stop = len(ids), int((ids == 0).sum())
    while end > stop:
        g = group[suffixes[end - 1]]
        word, members = length[g], sorted(suffixes[g:end])
        end, last, row = g, -1, 0
        takers: dict[tuple[int, int], list[int]] = {}
        for i in [*members, None]:
            j = -1
            if i is not None:
                out[i], j = word, i - 1
                while j >= 0 and group[j] >= g:
                    j = before[j]
                before[i] = j
                if j == last:
                    row += 1
                    continue
            if last >= 0 and group[last] >= stop:
                takers.setdefault((row, group[last]), []).append(last)
            last, row = j, 1
        for row, h in sorted(takers, reverse=True):  # what takes more words on is larger
            moved, top, grown = takers[row, h], h + size[h], length[h] + row * word
            for j in moved:
                top -= 1
                at, other = place[j], suffixes[top]
                suffixes[at], suffixes[top], place[other], place[j] = other, j, at, top
            size[h] = top - h
            size[top], length[top] = len(moved), grown
            for j in moved:
                group[j] = top
    return np.array(out, dtype=np.int64)


class _Extensions:
    """Longest common extensions: names of all stretches of 1, 2, 4 ... places, as long as any two are equal."""

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        name = ids + n
        gaps = np.flatnonzero(ids == 0)
        name[gaps] = np.arange(len(gaps))  # separators all differ
        self.names = [np.unique(name, return_inverse=True)[1]]
        while (width := 1 << len(self.names)) <= n:
            last = self.names[-1]
            half = width >> 1
            found, name = np.unique(last[: n - width + 1] * n + last[half : half + n - width + 1], return_inverse=True)
            if len(found) == len(name):
                break
            self.names.append(name)

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the stretches from ``i`` and from ``j`` on are equal."""
        out = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, here = self.names[k], np.flatnonzero(np.maximum(i, j) + out < len(self.names[k]))
            out[here[name[i[here] + out[here]] == name[j[here] + out[here]]]] += 1 << k
        return out

    def upto(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far back the stretches that end before ``i`` and before ``j`` are equal."""
        out = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, width = self.names[k], 1 << k
            here = np.flatnonzero(np.minimum(i, j) - out - width >= 0)
            out[here[name[i[here] - out[here] - width] == name[j[here] - out[here] - width]]] += width
        return out


def maximal_runs(ids: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of every maximal run of at least ``least`` places and two periods in ``ids`` (over 0; 0: a separator), by start and period.

    The root of a run, its longest Lyndon word under one of the two orders, starts in the run, so the Lyndon words of all places are the candidates. One is
    the root of a run if it goes on for at least its own length, left and right together."""
    found = [np.zeros((0, 3), dtype=np.int64)]
    if len(ids):
        ids = np.where(ids == 0, 0, np.unique(ids, return_inverse=True)[1] + 1)
        reach = _Extensions(ids)
        for order in (ids, np.where(ids == 0, 0, ids.max() + 1 - ids)):
            period = lyndon_lengths(order)
            i = np.flatnonzero((period > 0) & (np.arange(len(ids)) + period < len(ids)))
            j = i + period[i]
            right, left = reach.after(i, j), reach.upto(i, j)
            run = np.stack([i - left, left + period[i] + right, period[i]], axis=1)
            found.append(run[(left + right >= period[i]) & (run[:, 1] >= least)])
    out = np.unique(np.concatenate(found), axis=0)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _recurring(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Whether each word lies in ``n`` words that occur twice or more in its text. A run of 2 * n words or more lies in such words altogether."""
    value, at = windows(hashes, doc, tuple(range(n)))
    value = mix(value ^ (doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(value, kind="stable")
    same = np.zeros(len(value) + 1, dtype=bool)
    same[1:-1] = value[order][1:] == value[order][:-1]
    twice = at[order[same[:-1] | same[1:]]]
    step = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + n, -1)
    return np.cumsum(step[:-1]) > 0


def runs_of(values: pa.Array, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Rows of texts and (start, length, period) of their runs, in order. Only stretches whose words recur are looked at, all of them at once."""
    words = tokenize(values, SPACES, fold=False)
    here = np.flatnonzero(_recurring(words.hash, words.doc, least // 2))
    if not len(here):
        return np.zeros(0, dtype=np.int64), np.zeros((0, 3), dtype=np.int64)
    cut = np.flatnonzero((np.diff(here) > 1) | (np.diff(words.doc[here]) > 0)) + 1
    own, known = words.data.tobytes(), {}
    ids = np.array([known.setdefault(own[a:b], len(known) + 1) for a, b in zip(words.start[here].tolist(), words.end[here].tolist(), strict=True)], dtype=np.int64)
    place = np.insert(here, cut, -1)  # of each place of the stretches, put one after the other, among the words
    runs = maximal_runs(np.insert(ids, cut, 0), least)
    start = place[runs[:, 0]]
    doc = words.doc[start]
    runs[:, 0] = start - np.searchsorted(words.doc, doc)
    return doc, runs


def _collapsed(text: bytes, runs: np.ndarray) -> str:
    """The words, joined by one space, without those that a run contains after its first period."""
    words = text.split()
    if len(runs):
        step = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(step, runs[:, 0] + runs[:, 2], 1)
        np.add.at(step, runs[:, 0] + runs[:, 1], -1)
        words = list(compress(words, (np.cumsum(step[:-1]) == 0).tolist()))
    return b" ".join(words).decode()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``id_col``, ``runs`` (start, length and period in words, by start and period) and ``collapsed``, the text without the repeats of its runs.

    Words are what lies between ASCII spaces, case counts. A run is a maximal stretch with a smallest period that it holds at least twice, of ``least``
    words or more. Null and empty texts have no runs and an empty ``collapsed``; every row is judged by itself, repeated rows and
    null ids too; other columns are ignored; no rows give no rows. A text is one task's work: time and memory are in proportion to its length."""
    out = pa.schema([("id", pa.string()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            doc, runs = runs_of(batch.column("text"), least)
            data, offsets = text_bytes(batch.column("text"))
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            cells = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], fields=list(out.field("runs").type.value_type))
            texts = [_collapsed(data[a:b].tobytes(), runs[x:y]) for a, b, x, y in zip(offsets[:-1], offsets[1:], first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(first, type=pa.int32()), cells), pa.array(texts, type=pa.string())], schema=out)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id string, runs {_RUNS}, collapsed string")
    return rows.select(F.col("id").cast(kind).alias(id_col), "runs", "collapsed")


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the text's end, for a tenth of the documents by the CRC-32 of doc_id, is some of its words again and again. A null id's text stays."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.try_mod("g", F.col("n").cast("long")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.try_element_at("words", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int"))))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli (ties: smallest start, then period; no run: nulls), and digests of all runs and of
    the collapsed text, over ``looped`` texts."""
    runs = F.col("runs")
    best = F.try_element_at(F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("down"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(1))
    text = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    rows = periodic_runs(looped(docs)).withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.down")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.down") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(text, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Every pair of equal words in a document, as stretches of words that are equal at one distance.
ORACLE = f"""WITH {crc32_sql("(SELECT DISTINCT doc_id AS id FROM documents)")},
plain AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
rules AS (SELECT rid, doc_id, ws, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN ((h // 10) % len(ws))::BIGINT END AS a, ((h // 10) % 8)::BIGINT AS k FROM plain LEFT JOIN crcs ON id = doc_id),
rules2 AS (SELECT *, 1 + (len(ws) - a) // (3 + k) AS p FROM rules),
texts AS (SELECT rid, doc_id, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(0, len(ws)), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) END AS ws FROM rules2),
words AS (SELECT rid, unnest(range(0, len(ws))) AS i, unnest(ws) AS w FROM texts),
pairs AS (SELECT x.rid, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.rid = y.rid AND x.w = y.w AND x.i < y.i),
islands AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY rid, q, island HAVING count(*) >= q AND count(*) + q >= {LEAST}),
runs AS (SELECT rid, start, length, min(q) AS period FROM stretches GROUP BY ALL),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT w.rid, string_agg(w.w, ' ' ORDER BY w.i) AS t FROM words w ANTI JOIN gone g ON g.rid = w.rid AND g.i = w.i GROUP BY w.rid),
digests AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t, min({{'d': -length, 's': start, 'p': period}}) AS b FROM runs GROUP BY rid)
SELECT d.doc_id, coalesce(r.n_runs, 0)::BIGINT AS n_runs, r.b.s::BIGINT AS start, (-r.b.d)::BIGINT AS length, r.b.p::BIGINT AS period, (1000 * -r.b.d // r.b.p)::BIGINT AS exponent_milli,
sha256(coalesce(r.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM plain d LEFT JOIN digests r ON r.rid = d.rid LEFT JOIN kept k ON k.rid = d.rid"""
