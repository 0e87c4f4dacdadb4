"""Named steps over tables with inputs, cached by what they are made from; resuming; claim rules."""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A step: a function of its inputs' tables and its parameters. A new version means new results."""

    name: str
    make: Callable[..., DataFrame]
    inputs: tuple[str, ...] = ()
    parameters: dict = field(default_factory=dict)
    version: int = 1


class Workflow:
    """An acyclic set of nodes. Each result is kept under a key made from its node and its inputs' keys,
    so that a second run reads what hasn't changed."""

    def __init__(self, nodes: Sequence[Node]):
        self.nodes = {n.name: n for n in nodes}
        if len(self.nodes) != len(nodes):
            raise ValueError("two nodes share a name")
        if unknown := sorted({i for n in nodes for i in n.inputs} - set(self.nodes)):
            raise ValueError(f"unknown inputs: {unknown}")
        self.order = self._sorted()

    def _sorted(self) -> list[str]:
        open_, out = {n: set(x.inputs) for n, x in self.nodes.items()}, []
        while ready := sorted(n for n, left in open_.items() if not left):
            for n in ready:
                del open_[n]
            for left in open_.values():
                left.difference_update(ready)
            out += ready
        if open_:
            raise ValueError(f"a cycle: {sorted(open_)}")
        return out

    def keys(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for name in self.order:
            n = self.nodes[name]
            said = json.dumps([name, n.version, n.parameters, [out[i] for i in n.inputs]], sort_keys=True)
            out[name] = hashlib.sha256(said.encode()).hexdigest()
        return out

    def run(self, spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict[str, str]]:
        """Tables by node, and whether each was `read` or `made`. A table is whole once its marker is
        there; one without it, left by a lost run, is made anew."""
        tables, said = {}, {}
        for name, key in self.keys().items():
            path = f"{folder.rstrip('/')}/{name}-{key[:32]}"
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
            there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
            if not there:
                n = self.nodes[name]
                n.make(*[tables[i] for i in n.inputs], **n.parameters).write.mode("overwrite").parquet(path)
            tables[name], said[name] = spark.read.parquet(path), "read" if there else "made"
        return tables, said


def resume(spark: SparkSession, units: DataFrame, key: str, path: str, make: Callable[[DataFrame], DataFrame], through: int | None = None) -> DataFrame:
    """Results of units by key, appended to what a table at the path holds already; with `through` no
    more than the first so many units by key are worked on in all."""
    wanted = units.orderBy(key).limit(through) if through is not None else units
    try:
        done = spark.read.parquet(path).select(key).distinct()
        left = wanted.join(done, key, "left_anti")
    except pyspark.errors.AnalysisException:  # nothing there yet
        left = wanted
    make(left).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def environment(spark: SparkSession) -> DataFrame:
    """What runs here: name, value, and whether it suits."""
    import numpy
    import pandas
    import pyarrow

    rows = [("python", platform.python_version(), platform.python_version_tuple() >= ("3", "10")), ("spark", spark.version, spark.version >= "4")]
    rows += [(m.__name__, m.__version__, True) for m in (numpy, pandas, pyarrow)]
    shared = spark.conf.get("spark.checkpoint.dir", None)
    rows.append(("shared folder", shared or "", bool(shared) or spark.sparkContext.master.startswith("local")))
    return spark.createDataFrame(rows, "name string, value string, suits boolean")


#: From most to least.
MATURITY = ("validated", "established", "experimental", "research_only", "unsupported_for_claim")


def result_maturity(spec: DataFrame) -> DataFrame:
    """What a result may be called, given what its method is and what was done: adds `maturity`,
    `downgraded` and `reasons` (joined by commas) to rows with `method` and the rules' flags."""
    c = F.col
    rules: list[tuple[Column, str, str]] = [
        (~c("provenance_complete"), "unsupported_for_claim", "provenance_incomplete"),
        (~c("converged"), "unsupported_for_claim", "nonconverged"),
        (c("severe_failure"), "unsupported_for_claim", "severe_diagnostic_failure"),
        (c("approximate") & ~c("error_validated"), "research_only", "approximate_mode_without_validated_error_or_calibration"),
        (c("clinical_claim") & ~c("externally_validated"), "experimental", "predictive_clinical_claim_without_external_validation"),
        (c("causal_claim") & ~c("identified"), "unsupported_for_claim", "causal_identification_unsupported"),
        (c("bayesian") & ~(c("calibrated") & c("predictive_checked")), "experimental", "bayesian_requirements_incomplete"),
    ]
    rank = lambda x: F.array_position(F.array(*map(F.lit, MATURITY)), x)
    worst = F.greatest(rank(c("method")), *[F.when(test, rank(F.lit(cap))).otherwise(F.lit(0).cast("long")) for test, cap, _ in rules])
    out = spec.withColumn("maturity", F.element_at(F.array(*map(F.lit, MATURITY)), worst.cast("int")))
    return out.withColumns({"downgraded": c("maturity") != c("method"), "reasons": F.concat_ws(",", *[F.when(test, said) for test, _, said in rules])})


#: What a claim needs, from the least to the most.
LADDER = ("implementation_checked", "agrees_with_independent", "calibrated_by_simulation", "held_out", "external_cohort")


def validation_level(evidence: DataFrame, unit: str) -> DataFrame:
    """evidence(unit, step, passed) -> unit, level: the last step of the ladder up to which all passed."""
    passed = evidence.groupBy(unit).agg(*[F.bool_or(F.when(F.col("step") == s, F.col("passed")).otherwise(False)).alias(f"s{k}") for k, s in enumerate(LADDER)])
    level, whole = F.lit("none"), F.lit(True)
    for k, s in enumerate(LADDER):
        whole = whole & F.col(f"s{k}")
        level = F.when(whole, s).otherwise(level)
    return passed.select(unit, level.alias("level"))
