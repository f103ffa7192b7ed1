"""Corpus pipeline: sample, filter, rewrite, dedupe, validate, and the reports of a run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import config as C
from larder.functions.text import basic_validity, is_preferred_source
from larder.operators import dedupe as dd
from larder.operators import sampling as sm
from larder.operators import suitability as su
from larder.operators import validate as va
from larder.operators import variants as vr
from larder.operators.common import value_histogram
from larder.operators.inspect import inspect
from larder.session import materialize, share
from larder.sources.rules import Concept

MAX_EXAMPLES = 50


@dataclass(frozen=True)
class PipelineOptions:
    limit: int = 0  # rows to sample; 0 takes the whole corpus
    prefer: bool = True
    only: bool = False
    threshold: float = 12.0
    preferred: tuple[str, ...] = C.PREFERRED_SOURCES
    rules: C.VariantRules = C.VariantRules()


@dataclass(frozen=True)
class PipelineRun:
    sample: DataFrame
    inspect: dict[str, DataFrame]
    candidates: DataFrame
    funnel: DataFrame
    metrics: DataFrame


def staged_rows(rows: DataFrame, concepts: tuple[Concept, ...], threshold: float) -> DataFrame:
    """Rows with the flags of the three gates, each gate only counting rows of the one before.

    Validity is cheap and runs as a filter first; scoring and normalization see valid rows only.
    """
    valid = rows.where(basic_validity(F.col("title"), F.col("ingredients"), F.col("directions")))
    scored = su.with_suitability(su.with_normalized(valid, concepts), concepts)
    suitable = F.col("suitability.total") >= threshold
    return scored.withColumn("suitable", suitable).withColumn("usable", suitable & (F.size("normalized") >= 2))


def accepted_variants(staged: DataFrame, concepts: tuple[Concept, ...], rules: C.VariantRules) -> DataFrame:
    return vr.variants(staged.where("usable"), concepts, rules)


def pipeline_funnel(rows: DataFrame, staged: DataFrame, made: DataFrame, deduped: DataFrame) -> DataFrame:
    """``(stage, n)`` after each gate."""
    def counted(df: DataFrame, **stages) -> DataFrame:
        one = df.agg(*[expr.alias(name) for name, expr in stages.items()])
        pairs = F.array(*[F.struct(F.lit(n).alias("stage"), F.col(n).alias("n")) for n in stages])
        return one.select(F.explode(pairs).alias("s")).select("s.stage", "s.n")

    everything = F.count(F.lit(1))
    return (
        counted(rows, scanned=everything)
        .unionByName(
            counted(
                staged, after_basic_validity=everything, after_suitability=F.count_if("suitable"),
                after_normalization=F.count_if("usable"),
            )
        )
        .unionByName(counted(made, after_variants=everything))
        .unionByName(
            counted(deduped, after_dedupe=everything, valid_candidates=F.count_if(F.col("status") != "unrepresentable"))
        )
    )


def band_histogram(df: DataFrame) -> DataFrame:
    return value_histogram(df, "band", C.BANDS)


def status_histogram(df: DataFrame) -> DataFrame:
    return value_histogram(df, "status", C.STATUSES)


def sample_pipeline(
    corpus: DataFrame, concepts: tuple[Concept, ...], catalog: DataFrame,
    options: PipelineOptions = PipelineOptions(),
) -> PipelineRun:
    """Corpus to validated candidates. Map-only from the sample up to the dedupe."""
    sample = share(_sampled(corpus, options))
    in_order = sample.withColumn("ordinal", _sample_position()).drop("sample_rank")
    staged = share(staged_rows(in_order, concepts, options.threshold))
    made = materialize(accepted_variants(staged, concepts, options.rules))
    deduped = share(va.validate_candidates(dd.dedupe(made), catalog))
    return PipelineRun(
        sample=sample,
        inspect=inspect(in_order, concepts),
        candidates=deduped,
        funnel=pipeline_funnel(sample, staged, made, deduped),
        metrics=sm.sample_metrics(corpus, sample, options.preferred),
    )


def _sampled(corpus: DataFrame, options: PipelineOptions) -> DataFrame:
    """The sample, or without a limit every row in the order that a reservoir of any size keeps."""
    if options.limit > 0:
        return sm.reservoir_sample(corpus, options.limit, options.prefer, options.only, options.preferred)
    preferred = is_preferred_source(F.col("source"), options.preferred)
    split = options.prefer or options.only
    rows = corpus.where(preferred) if options.only else corpus
    group = F.when(preferred, 0).otherwise(1) if split else F.lit(1)
    return rows.withColumn("sample_rank", F.struct(group.alias("sample_class"), F.col("ordinal").alias("slot")))


def _sample_position() -> Column:
    """One sortable number for ``sample_rank``: preferred slots, then the others."""
    return F.col("sample_rank.sample_class").cast("long") * F.lit(1 << 40) + F.col("sample_rank.slot")


def validate_stage_counts(candidates: DataFrame, catalog: DataFrame, limit: int = 15) -> dict[str, DataFrame]:
    """Dedupe, validate, then status counts and the most missed names."""
    checked = share(va.validate_candidates(dd.dedupe(candidates), catalog))
    return {"status": status_histogram(checked), "top_missing": va.top_missing(checked, limit)}


def examples_with_source(candidates: DataFrame, corpus: DataFrame, limit: int = MAX_EXAMPLES) -> DataFrame:
    """The first candidates next to the corpus row they came from."""
    first = candidates.orderBy(F.desc("score.total"), F.asc("ordinal")).limit(limit)
    ids = F.broadcast(first.select("source_id").distinct())
    source = corpus.select(
        F.col("id").alias("source_id"), F.col("title").alias("original_title"), F.col("ingredients").alias("original")
    ).join(ids, "source_id", "left_semi")
    return first.join(source, "source_id", "left")
