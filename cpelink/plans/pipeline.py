"""End-to-end batch run: inputs -> matches -> host x vulnerability table -> reports.

Each stage result that is reused or expensive (candidate pairs carry the
Python scorer) is written as a Parquet stage table below ``stage_dir``
(a shared folder) and read back, which cuts lineage: a lost executor
recomputes from the last written stage, not from the raw inputs. Written
stages also give the planner real sizes for its broadcast decisions.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass, field, fields

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import candidates as CA
from ..operators import classify as CL
from ..operators import clean as C
from ..operators import enrich as E
from ..operators import reports as R
from ..operators import rollup as RU
from ..sources import files as S


@dataclass
class Inputs:
    hosts: DataFrame          # raw hosts (5 columns)
    software: DataFrame       # raw inventory, arch-tagged (union of both dumps)
    cpe: DataFrame            # flat catalogue: name, cpe23, title, deprecated
    cve: DataFrame            # flat feed rows: cve_id, product, score, complexity, vector
    vendor_labels: DataFrame  # publisher0, vendor_X, match
    software_labels: DataFrame  # software keys, match, t_cve_name
    stop_words: list[str] = field(default_factory=lambda: list(K.STOP_WORDS))


def _digest(df: DataFrame) -> str:
    """Order-free digest of a table's rows and schema, combined map-side."""
    rows = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)"))).first()
    return f"{df.schema.simpleString()}:{rows[0]}:{rows[1]}"


def fingerprint(inp: Inputs, parameters: dict) -> str:
    """What a run's stages depend on: the rows of its inputs and its parameters."""
    tables = [f"{f.name}={_digest(v)}" for f in fields(inp) if isinstance(v := getattr(inp, f.name), DataFrame)]
    text = "\n".join([*tables, *inp.stop_words, *(f"{k}={v}" for k, v in sorted(parameters.items()))])
    return hashlib.sha256(text.encode()).hexdigest()


class Stages:
    """Stage tables below one folder; with a fingerprint, those that an earlier run with the same one has
    committed are loaded and all others are computed and marked with it."""

    def __init__(self, spark: SparkSession, stage_dir: str, mark: str | None):
        self.spark, self.dir, self.mark = spark, stage_dir, mark

    def _path(self, *parts: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(self.dir, *parts))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def done(self, name: str) -> bool:
        if self.mark is None:
            return False
        (fs, success), (_, mark) = self._path(name, "_SUCCESS"), self._path("_fingerprints", name, self.mark)
        return fs.exists(success) and fs.exists(mark)

    def __call__(self, df, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write a stage table (a DataFrame, or a function that builds it) and continue from the written copy."""
        if not self.done(name):
            fs, marks = self._path("_fingerprints", name)
            fs.delete(marks, True)
            S.save_stage(df() if callable(df) else df, self.dir, name, partition_by)
            if self.mark is not None:
                fs, mark = self._path("_fingerprints", name, self.mark)
                fs.mkdirs(mark)
        return S.load_stage(self.spark, self.dir, name, None if callable(df) else df.schema)


def _name(hook) -> str:
    return "" if hook is None else f"{hook.__module__}.{hook.__qualname__}"


def run(spark: SparkSession, inp: Inputs, stage_dir: str,
        enrich: E.EnrichHook | None = None, reports: E.ReportHook | None = None,
        vendor_model: PipelineModel | None = None, software_model: PipelineModel | None = None,
        publisher_key: str = "normalized", fill_version_on_join: bool = False,
        resume: bool = False, version: str = "") -> dict[str, DataFrame]:
    """Run all stages; returns the final table and the report frames.

    ``resume=True`` reuses the stage tables that an earlier resumable run with
    the same inputs and parameters has committed under ``stage_dir`` (restart
    after a failure without redoing finished stages); a stage of other inputs,
    labels, models or parameters is computed again. Hooks count by their names:
    give another ``version`` when their code changes.
    """
    mark = None
    if resume:
        mark = fingerprint(inp, {
            "enrich": _name(enrich), "vendor_model": getattr(vendor_model, "uid", ""),
            "software_model": getattr(software_model, "uid", ""), "publisher_key": publisher_key,
            "fill_version_on_join": fill_version_on_join, "version": version, "sft_vuln": "nested"})
    stage = Stages(spark, stage_dir, mark)
    done = stage.done
    hosts = C.clean_hosts(inp.hosts)
    if enrich is not None:
        hosts = hosts.transform(enrich)
    hosts = stage(hosts, "hosts")
    software = stage(C.clean_inventory(inp.software), "software", ["arch_X"])
    cpe = stage(C.clean_cpe(inp.cpe), "cpe")
    worst = stage(RU.worst_case(inp.cve), "worst_case")

    # vendor stage
    vcands = stage(lambda: CA.name_lengths_vendor(CA.vendor_candidates(software, cpe, inp.stop_words)),
                   "vendor_candidates")
    if vendor_model is None and not done("vendor_match"):
        looked = CL.pair_complete(CL.label_lookup(vcands, inp.vendor_labels, K.VENDOR_KEYS),
                                  K.VENDOR_KEYS + K.VENDOR_FEATURES)
        vendor_model = CL.train(CL.split_labelled(looked)[1], K.VENDOR_FEATURES, K.VENDOR_FOREST)
    vmatch = stage(lambda: CL.vendor_match(vcands, inp.vendor_labels, vendor_model),
                   "vendor_match")

    # software stage
    products = CA.products_of(software, vmatch, publisher_key)
    scands = stage(lambda: CA.software_candidates(products, cpe), "software_candidates")
    if software_model is None and not done("software_match"):
        lab = CL.split_labelled(CL.label_lookup(scands, inp.software_labels, K.SOFTWARE_KEYS))[1]
        software_model = CL.train(lab, K.SOFTWARE_FEATURES, K.SOFTWARE_FOREST)
    smatch = stage(lambda: CL.software_match(scands, inp.software_labels, software_model),
                   "software_match")

    # an item's rows share its own columns and its host's: the stage table holds these once and the products in a list
    vulns = RU.flatten(stage(RU.nested_hosts_with_vulns(hosts, software, smatch, worst, fill_version_on_join),
                             "sft_vuln"))
    out = {
        "sft_vuln": vulns,
        "vendor_match": vmatch,
        "software_match": smatch,
        "top25_sft_high": R.top_high(vulns),
        "site_by_criticality": R.top_sites(vulns),
    }
    if reports is not None:
        out.update(reports(vulns))
    return out
