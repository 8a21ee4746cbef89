"""False-positive rates of filters: measured, compared, swept over hash counts and sizes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import theory
from ..plans.config import FilterSpec
from . import filters


def measure(inserts: DataFrame, tests: DataFrame, specs: Iterable[FilterSpec], spark: SparkSession) -> DataFrame:
    """filter_id, bits_set, false_positives, tested, rate of filters holding ``inserts`` (item), probed with ``tests`` (item).

    The rate is over all tests, members included.  All filters are built and probed in one job; items meet the
    filters' parameters, one row each, by a broadcast.  Members are told by one sum over inserts and tests, so that
    nothing that grows with the items is ever broadcast; equal tests are probed once.
    """
    specs = list(specs)
    f = filters.params(spark, specs)
    names = F.explode(F.array(*[F.lit(s.filter_id) for s in specs])).alias("filter_id")
    words = filters.build(inserts.select("item").distinct().select(names, "item"), f, n_filters=len(specs))
    both = tests.select("item", F.lit(1).alias("times"), F.lit(False).alias("member")).unionByName(
        inserts.select("item", F.lit(0).alias("times"), F.lit(True).alias("member"))
    )
    t = both.groupBy("item").agg(F.sum("times").alias("times"), F.bool_or("member").alias("member")).where("times > 0")
    t = t.select(names, "item", "times", (F.col("member") & F.col("item").isNotNull()).alias("member"))
    probed = filters.probe(t, f, words, bits=sum(s.m for s in specs), n_filters=len(specs))
    out = probed.groupBy("filter_id").agg(
        F.sum(F.when(F.col("passes") & ~F.col("member"), F.col("times")).otherwise(0)).alias("false_positives"), F.sum("times").alias("tested")
    )
    return out.join(filters.bit_counts(f, words), "filter_id").select(
        "filter_id", "bits_set", "false_positives", "tested", (F.col("false_positives") / F.col("tested")).alias("rate")
    )


def compare(inserts: DataFrame, tests: DataFrame, m: int, n: int, spark: SparkSession) -> DataFrame:
    """Standard against rational filter at the best hash count for ``m`` bits and ``n`` elements, in one row."""
    k = max(0.1, m / n * 0.6931471805599453)
    specs = [FilterSpec("standard", "standard", m, max(1, round(k))), FilterSpec("rational", "rational", m, k)]
    r = measure(inserts, tests, specs, spark)
    one = r.groupBy().pivot("filter_id", ["standard", "rational"]).agg(F.first("rate"))
    return one.select("standard", "rational", theory.improvement_percent(F.col("standard"), F.col("rational")).alias("improvement_percent"))


def sweep_hashes(inserts: DataFrame, tests: DataFrame, m: int, ks: Iterable[float], spark: SparkSession) -> DataFrame:
    """kind, k, bits_set, rate for each hash count; a standard filter takes the nearest whole one (half to even)."""
    specs = [s for k in ks for s in (FilterSpec(f"standard:{k}", "standard", m, round(k)), FilterSpec(f"rational:{k}", "rational", m, k))]
    return _named(measure(inserts, tests, specs, spark), "k", "double")


def sweep_sizes(inserts: DataFrame, tests: DataFrame, ms: Iterable[int], n: int, spark: SparkSession) -> DataFrame:
    """kind, m, bits_set, rate for each size, at that size's best hash counts."""
    specs = []
    for m in ms:
        k = max(0.1, m / n * 0.6931471805599453)
        specs += [FilterSpec(f"standard:{m}", "standard", m, max(1, round(k))), FilterSpec(f"rational:{m}", "rational", m, k)]
    return _named(measure(inserts, tests, specs, spark), "m", "long")


def _named(rates: DataFrame, name: str, kind: str) -> DataFrame:
    part = F.split("filter_id", ":")
    return rates.select(part[0].alias("kind"), part[1].cast(kind).alias(name), "bits_set", "rate")


def trials(rates: DataFrame, expected: float) -> DataFrame:
    """trials, mean_rate, relative_error_percent of rows with a rate, against a theoretical one."""
    mean = F.avg("rate")
    return rates.agg(
        F.count("*").alias("trials"), mean.alias("mean_rate"), (F.abs(mean - expected) / expected * 100).alias("relative_error_percent")
    )
