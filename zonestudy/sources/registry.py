"""All studies run, all trials, and all looks at holdouts, as append-only tables."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonestudy.operators.stats import deflated_threshold
from zonestudy.plans.spec import Spec
from zonestudy.sources.tables import read_events, write_events

_NUMBERS = ("n", "rate", "ci_low", "ci_high", "mean_r", "baseline_rate", "p_value", "ambiguous")
_KEYS = "id string, created_at timestamp, name string, symbol string, fingerprint string, family string, spec_json string, data_fingerprint string, start string, end string, "
STUDIES = _KEYS + "n long, " + ", ".join(f"{c} double" for c in _NUMBERS[1:]) + ", summary_json string"
TRIALS = "created_at timestamp, symbol string, name string, fingerprint string, family string, n long, rate double, mean_r double, p_value double, study_id string"
COMMITS = "id string, committed_at timestamp"
#: Different rules tried from which on the threshold counts.
MANY = 20
REVEALS = "revealed_at timestamp, family string, fingerprint string, study_id string, n long, rate double, ci_low double, ci_high double"


def family_key(symbol: Column, detector: Column, direction: Column) -> Column:
    """What is one idea with other settings: symbol (or any), detector and direction."""
    return F.concat_ws("|", F.when(F.length(symbol) > 0, symbol).otherwise("*"), detector, direction)


def reveal_level(looks: Column) -> Column:
    """How many looks at a family's holdout call for a word: none, one or two, or more."""
    return F.when(looks >= 3, "error").when(looks >= 1, "warning").otherwise("none")


@dataclass
class Registry:
    """Tables under ``root``. Rows are only added, so writers don't wait for each other; ids are unique without a counter.

    A study is its events, its row and its trial. They are seen once a last row says that all three are there; what a writer that broke off
    has left is never seen, nor counted."""

    spark: SparkSession
    root: str

    def _read(self, table: str, schema: str) -> DataFrame:
        """The table; without rows while nothing was added to it."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _add(self, table: str, schema: str, row: tuple) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{table}")

    def append_study(self, spec: Spec, summary: DataFrame, events: DataFrame, symbol: str, data_fingerprint: str, start: str, end: str) -> str:
        """Adds a study with its summary (one row) and events, and a trial, all at once for readers; returns its id."""
        s, now, sid = summary.first().asDict(), datetime.now(timezone.utc), uuid.uuid4().hex
        values = tuple(s.get(c) for c in _NUMBERS)
        write_events(events, f"{self.root}/events", sid)
        self._add("studies", STUDIES, (sid, now, spec.name, symbol, spec.fingerprint(), spec.family(), spec.to_json(), data_fingerprint, start, end, *values, json.dumps(s, default=str)))
        self._add("trials", TRIALS, (now, symbol, spec.name, spec.fingerprint(), spec.family(), s.get("n"), s.get("rate"), s.get("mean_r"), s.get("p_value"), sid))
        self._add("commits", COMMITS, (sid, datetime.now(timezone.utc)))
        return sid

    def _whole(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows of studies that are there as a whole."""
        return rows.join(self._read("commits", COMMITS).select(F.col("id").alias(key)), key, "left_semi")

    def _studies(self) -> DataFrame:
        return self._whole(self._read("studies", STUDIES), "id")

    def list_studies(self) -> DataFrame:
        """Newest first, without the long texts."""
        return self._studies().drop("spec_json", "summary_json").orderBy(F.desc("created_at"), "id")

    def get_study(self, sid: str) -> DataFrame:
        return self._studies().filter(F.col("id") == sid)

    def load_events(self, sid: str) -> DataFrame:
        """The events of a study; a KeyError for one that isn't there as a whole."""
        if self._whole(self._read("commits", COMMITS).filter(F.col("id") == sid), "id").isEmpty():
            raise KeyError(sid)
        return read_events(self.spark, f"{self.root}/events", sid)

    def trial_counts(self) -> DataFrame:
        """One row: trials, distinct_trials (by rules) and the threshold that so many trials put on a finding."""
        t = self._whole(self._read("trials", TRIALS), "study_id").agg(F.count("*").alias("trials"), F.count_distinct("fingerprint").alias("distinct_trials"))
        return t.withColumn("deflated_threshold", deflated_threshold(F.col("distinct_trials")))

    def threshold_applies(self) -> bool:
        """Whether so many different rules were tried, more than ``MANY``, that a finding must pass the threshold of ``trial_counts``."""
        return self.trial_counts().first().distinct_trials > MANY

    def log_reveal(self, spec: Spec, summary: DataFrame, study_id: str | None = None) -> None:
        s = summary.first().asDict()
        self._add("reveals", REVEALS, (datetime.now(timezone.utc), spec.family(), spec.fingerprint(), study_id, *(s.get(c) for c in ("n", "rate", "ci_low", "ci_high"))))

    def reveal_history(self, family: str) -> DataFrame:
        return self._read("reveals", REVEALS).filter(F.col("family") == family).orderBy("revealed_at")

    def reveal_count(self, family: str) -> DataFrame:
        """One row: looks, and the level they call for."""
        return self.reveal_history(family).agg(F.count("*").alias("looks")).withColumn("level", reveal_level(F.col("looks")))
