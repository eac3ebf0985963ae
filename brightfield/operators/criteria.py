"""What a judge is asked to look for: criteria as a table, as thresholds, and as the text of a prompt."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import object_text, path_value

# What the scores of a criterion without a rubric of its own mean.
RUBRIC = {4: "fully satisfies the criterion", 3: "mostly satisfies it with a minor issue", 2: "partially satisfies it with a noticeable issue", 1: "barely satisfies it", 0: "clearly fails it"}
SCHEMA = "criterion_id string, description string, scope string, severity string, rubric map<int,string>, evidence_required boolean, min_score double, max_failures int"


@dataclass(frozen=True)
class CriteriaSet:
    """Criteria (rows by :data:`SCHEMA`) with the thresholds that a whole batch must meet."""

    rows: tuple[dict, ...]
    name: str = "default"
    description: str = ""
    thresholds: dict = field(default_factory=dict)

    def table(self, spark: SparkSession) -> DataFrame:
        names = [x.split()[0] for x in SCHEMA.replace("map<int,string>", "map").split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in self.rows], SCHEMA)

    def prompt(self) -> str:
        """The set's name and description, and a line of JSON for each criterion."""
        said = [{"id": r["criterion_id"], **{k: r[k] for k in ("scope", "severity", "description", "rubric", "evidence_required")}} for r in self.rows]
        return "\n".join([f"Criteria set: {self.name}", *([self.description] if self.description else []), *(json.dumps(x, ensure_ascii=False, sort_keys=True) for x in said)])


#: Thresholds of a set that names none.
THRESHOLDS = {"max_critical_failures": 0, "min_mean_score": 3.0, "min_session_pass_rate": 1.0, "max_first_failure_rate": None}


def criteria_set(spec: dict | list) -> CriteriaSet:
    """A set from a mapping (``criteria``, ``name``, ``description``, thresholds) or a list of criteria; each has ``id`` and ``description``."""
    spec = {"criteria": spec} if isinstance(spec, list) else spec
    rows = []
    for c in spec.get("criteria", []):
        if not c.get("id") or not c.get("description"):
            raise ValueError("a criterion has an id and a description")
        rubric = RUBRIC if c.get("rubric") is None else {int(k): str(v) for k, v in c["rubric"].items()}
        limit = c.get("max_failures")
        rows.append({
            "criterion_id": str(c["id"]), "description": str(c["description"]), "scope": str(c.get("scope", "session")), "severity": str(c.get("severity", "major")), "rubric": rubric,
            "evidence_required": bool(c.get("evidence_required", True)), "min_score": float(c.get("min_score", 3.0)), "max_failures": None if limit is None else int(limit),
        })
    if len({r["criterion_id"] for r in rows}) < len(rows):
        raise ValueError("two criteria share an id")
    limits = {k: type(v)(spec[k]) if v is not None and spec.get(k) is not None else spec.get(k, v) for k, v in THRESHOLDS.items()}
    return CriteriaSet(tuple(rows), str(spec.get("name", "default")), str(spec.get("description", "")), limits)


def corpus_verdict(reply: Column) -> Column:
    """``passed, score, summary`` of an overseer's reply on a whole corpus: a reply that is no JSON object does not pass."""
    js = object_text(reply)
    return F.struct(
        F.coalesce(path_value(js, "passed") == "true", F.lit(False)).alias("passed"),
        F.greatest(F.lit(0.0), F.least(F.lit(4.0), F.coalesce(path_value(js, "score").try_cast("double"), F.lit(0.0)))).alias("score"),
        F.coalesce(path_value(js, "summary"), F.lit("no verdict could be read")).alias("summary"),
    )


def calibration(findings: DataFrame, expected: DataFrame) -> DataFrame:
    """``session_id, should_pass, critical, found, as_expected``: whether a validator finds what fixtures were made to show.

    ``expected`` has ``session_id, should_pass, must_find`` (array of criterion ids). A fixture that should pass has no
    critical finding; one that should not has a finding of every criterion named.
    """
    by = findings.groupBy("session_id").agg(F.array_sort(F.collect_set("criterion_id")).alias("found"), F.count_if(F.col("severity") == "critical").alias("critical"))
    out = expected.join(by, "session_id", "left").withColumns({"found": F.coalesce("found", F.array().cast("array<string>")), "critical": F.coalesce("critical", F.lit(0).cast("long"))})
    good = F.when(F.col("should_pass"), F.col("critical") == 0).otherwise(F.size(F.array_except("must_find", "found")) == 0)
    return out.select("session_id", "should_pass", "critical", "found", good.alias("as_expected"))
