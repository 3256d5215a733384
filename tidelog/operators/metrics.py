"""Counters, latency histograms, percentiles, rates, quotas."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ranking import running_max, running_sum

#: Upper bounds of the latency buckets in milliseconds.
BOUNDS = (1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000)


def topic_counters(records: DataFrame) -> DataFrame:
    """Records and bytes of each topic, and of all (topic null), in one pass."""
    x = records.rollup("topic").agg(F.count(F.lit(1)).alias("records"), F.sum("bytes").alias("bytes"), F.grouping("topic").cast("long").alias("is_total"))
    return x


def latency_histogram(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative counts by bound (le, +Inf last), with the sum of all: (keys, le, cumulative, total_ms)."""
    x = samples.groupBy(*keys).agg(*[F.count_if(F.col("ms") <= b).alias(f"b{b}") for b in BOUNDS], F.count(F.lit(1)).alias("bInf"), F.sum("ms").alias("total_ms"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{b}").alias("cumulative")) for b in BOUNDS] + [F.struct(F.lit("+Inf").alias("le"), F.col("bInf").alias("cumulative"))]
    return x.select(*keys, "total_ms", F.explode(F.array(*rows)).alias("r")).select(*keys, "r.le", "r.cumulative", "total_ms")


def nearest_rank(samples: DataFrame, keys: list[str], percents: list[int]) -> DataFrame:
    """The value at rank round(p / 100 * (n - 1)), ties up: from counts of equal values, added up in runs of values.

    Equal values are one row, and no window holds more than a run of distinct values.
    """
    counts = samples.groupBy(*keys, "ms").agg(F.count(F.lit(1)).alias("c"))
    x = running_sum(counts, keys, "ms", "c", "upto")
    totals = counts.groupBy(*keys).agg(F.sum("c").alias("n")).withColumnsRenamed({k: f"_{k}" for k in keys})
    match = functools.reduce(lambda a, k: a & x[k].eqNullSafe(totals[f"_{k}"]), keys, F.lit(True))
    x = x.join(totals, match).withColumn("p", F.explode(F.array(*[F.lit(p) for p in percents])))
    rank = F.floor(F.col("p") / 100.0 * (F.col("n") - 1) + 0.5)
    return x.filter((F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto"))).select(*keys, F.col("p").cast("long").alias("p"), "ms")


def throughput(records: DataFrame, keys: list[str]) -> DataFrame:
    """Records and megabytes a second between the first and last time; null where no time passes between them."""
    x = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), ((F.max("ts_ms") - F.min("ts_ms")) / 1000.0).alias("seconds"))
    return x.select(*keys, F.try_divide("n", "seconds").alias("records_per_s"), F.try_divide(F.col("bytes") / 1e6, F.col("seconds")).alias("mb_per_s"))


def escaped(label) -> Column:
    """A label's value as the text format wants it: backslash, quote and line end escaped."""
    c = F.replace(F.col(label), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(c, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def prometheus(counters: DataFrame) -> DataFrame:
    """Exposition lines of counters (metric, topic, value)."""
    label = F.when(F.col("topic").isNull(), F.lit("")).otherwise(F.concat(F.lit('{topic="'), escaped("topic"), F.lit('"}')))
    return counters.select(F.concat("metric", label, F.lit(" "), F.col("value").cast("string")).alias("line"))


def prometheus_histogram(histogram: DataFrame, metric: str, key: str) -> DataFrame:
    """Exposition lines of a latency histogram: its HELP and TYPE, a line a bucket, and each key's sum and count."""
    label = F.concat(F.lit(f'{{{key}="'), escaped(key), F.lit('"'))
    bucket = histogram.select(F.concat(F.lit(f"{metric}_bucket"), label, F.lit(',le="'), "le", F.lit('"} '), F.col("cumulative").cast("string")).alias("line"))
    last = histogram.filter("le = '+Inf'")
    total = last.select(F.concat(F.lit(f"{metric}_sum"), label, F.lit("} "), F.col("total_ms").cast("string")).alias("line"))
    count = last.select(F.concat(F.lit(f"{metric}_count"), label, F.lit("} "), F.col("cumulative").cast("string")).alias("line"))
    head = histogram.sparkSession.createDataFrame([(f"# HELP {metric} Latency in milliseconds.",), (f"# TYPE {metric} histogram",)], "line string")
    return head.unionByName(bucket).unionByName(total).unionByName(count)


def token_bucket(requests: DataFrame, rate: float, most_delay_ms: float = 60_000) -> DataFrame:
    """Adds delay_ms to requests (client_id, at_ms, seq, amount): a bucket of one second's burst for each client.

    A request at level x leaves min(rate, x + refill) - amount: of the form min(a, x + b), which is closed under
    composition. So the level after a request is s + min(rate, least a - s so far), where s adds up all b until then: a
    running sum and a running minimum, in runs of time, and no client's requests in one task.
    """
    by = ["at_ms", "seq"]
    x = requests.select("client_id", "at_ms", "seq", "amount")
    x = running_max(x, ["client_id"], by, "at_ms", "_earlier", include=False)
    refill = (F.col("at_ms") - F.coalesce("_earlier", "at_ms")) * F.lit(rate / 1000.0)
    x = x.withColumn("_b", refill - F.col("amount"))
    x = running_sum(x, ["client_id"], by, "_b", "_s", kind="double")
    x = x.withColumn("_up", F.col("_s") - (F.lit(rate) - F.col("amount")))
    x = running_max(x, ["client_id"], by, "_up", "_top")
    level = F.col("_s") + F.least(F.lit(rate), -F.col("_top"))
    delay = F.when(level < 0, F.least(F.lit(float(most_delay_ms)), -level / rate * 1000.0)).otherwise(F.lit(0.0))
    return x.select("client_id", "at_ms", "seq", "amount", delay.alias("delay_ms"))
