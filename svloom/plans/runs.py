"""The two runs of the caller, from reads to files, as their configurations say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svloom.operators.cut import cut, exists
from svloom.operators.jobs import pending
from svloom.operators.score import Scorer, score_windows
from svloom.plans import pipelines
from svloom.sources import readers, writers
from svloom.sources.config import CallConfig, GenerateConfig, feature_spec, resolve_head, resolve_spec, resolve_threshold

KEYS = ["contig", "region_start"]


def generate(reads: DataFrame, path: str, config: GenerateConfig = GenerateConfig()) -> dict:
    """The feature store of reads: dense windows by contig and region, with their specification; regions that are there stay unless overwrite.

    With subregion, scores are those of a subregion each. Features are stored as float; float16 ones are rounded to its eleven bits.
    """
    chosen = reads.filter(F.col("contig").isin(*config.contigs)) if config.contigs else reads
    size = config.subregion or config.region
    windows = pipelines.dense_windows(pipelines.generate_signals(chosen, size), size)
    windows = windows.withColumn("region_start", F.floor(F.col("window_start") / config.region) * config.region).withColumn("features", F.col("features").cast("array<float>"))
    if config.feature_dtype == "float16":
        windows = windows.withColumn("features", F.transform("features", half))
    spec = feature_spec()
    writers.write_store(windows, path, KEYS, config.overwrite, spec)
    return spec


def half(x):
    """A float with the eleven significant bits of a half-precision number, ties to even, within its range."""
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x).cast("double"))), F.lit(-14)) - 10)
    return F.when(x == 0, x).otherwise(F.greatest(F.least(F.bround(x / unit) * unit, F.lit(65504.0)), F.lit(-65504.0))).cast("float")


def call(reads: DataFrame, contigs: DataFrame, store: str, predictions: str, folder: str, name: str, scorer: Scorer, meta: dict | None = None, config: CallConfig = CallConfig(), profile=None) -> dict[str, int]:
    """Predictions of a feature store, then the six call files in folder; what was written and left out is returned.

    contigs: contig, length, ord. meta: the weights' metadata (threshold, head, feature_config). predict_only stops after the predictions, of
    which regions that are there already are kept; cluster_only takes the predictions that are there and needs no store.
    """
    spark, meta = reads.sparkSession, meta or {}
    threshold = resolve_threshold(config.threshold, {"decision_threshold": meta["threshold"]} if "threshold" in meta else {})
    if not config.cluster_only:
        resolve_spec(readers.store_spec(spark, store), meta.get("feature_config"))
        windows = pipelines.chosen(readers.read_store(spark, store), config)
        if exists(spark, predictions):
            windows = pending(windows, readers.read_store(spark, predictions), KEYS)
        head = resolve_head(config.head, {"ablation": {"eval_head": meta["head"]}} if "head" in meta else {})
        scored = score_windows(windows, scorer, profile=profile).withColumn("head", F.lit(head))
        writers.write_store(scored, predictions, KEYS)
    if config.predict_only:
        return {}
    probs = readers.read_store(spark, predictions).select("contig", "window_start", "prob")
    calls = cut(pipelines.call_variants(reads, contigs, probs, threshold, config))
    ends = cut(pipelines.call_breakends(reads, contigs, probs, threshold, config))
    if config.refine:
        summary = calls.groupBy("svtype").agg(F.count("*").alias("n"))
        writers.write_refine_report(summary, f"{folder}/{name}_refine")
    return writers.write_call_files(calls, ends, contigs, folder, name)
