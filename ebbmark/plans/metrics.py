"""Queries that judge lateness policies from their metric tables.

House metrics hold one row per strategy, house and window (an upsert keyed by window end). Taxi
metrics are a log stamped with the write time, so speculative windows have one row per update and
readers reduce them to the final version. Strategies are a grouping column throughout: one plan
answers for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ebbmark.functions.scalars import OUTSIDE, house_cell, label_of, one_if_missing, zero_if_missing, zone_cell

MAX_DELAY_S = 86_400
THEORETICAL_EVENTS = 10.0
GRID_CELLS = 10


# Metric tables from backtest results ----------------------------------------

def to_house_metrics(results: DataFrame) -> DataFrame:
    return results.select(
        F.timestamp_millis("window_end").alias("time"), F.col("key").alias("house_id"), "strategy",
        F.col("avg_1").alias("avg_temp"), F.col("avg_2").alias("avg_energy"), "decisional_latency_ms",
        "true_latency_ms", F.col("event_count").alias("pachete_count"), "is_final", "update_count")


def to_taxi_metrics(results: DataFrame) -> DataFrame:
    return results.select(
        F.timestamp_millis("fire_time").alias("time"), F.col("key").alias("zone_id"), "strategy",
        "true_latency_ms", (F.col("window_delay_ms") / 1000.0).alias("window_delay_s"), "event_count",
        F.col("avg_1").alias("avg_distance"), F.col("avg_2").alias("avg_duration"), "update_count", "window_end")


# Filters --------------------------------------------------------------------

def without_initial(metrics: DataFrame) -> DataFrame:
    return metrics.where(~F.col("house_id").rlike("-initial$"))


def without_outside(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("zone_id") != OUTSIDE)


def since(metrics: DataFrame, now: Column, interval: str) -> DataFrame:
    """Rows written within ``interval`` (such as ``2 hours``) before ``now``."""
    return metrics.where(F.col("time") > now - F.expr(f"interval {interval}"))


def of_strategies(metrics: DataFrame, strategies: list[str]) -> DataFrame:
    return metrics.where(F.col("strategy").isin(strategies))


# Final versions and baselines -----------------------------------------------

def final_versions(metrics: DataFrame, keys: list[str], count: str) -> DataFrame:
    """The most complete row of each key; combines map-side, so no sort of the whole log."""
    rest = [c for c in metrics.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(zero_if_missing(F.col(count)),
                                              one_if_missing(F.col("update_count"))))
    return metrics.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def house_finals(metrics: DataFrame, speculative: str) -> DataFrame:
    rows = without_initial(metrics).where(F.col("strategy") == speculative)
    return final_versions(rows.where(F.col("pachete_count").isNotNull()), ["time", "house_id"], "pachete_count")


def taxi_finals(metrics: DataFrame, speculative: str, include_outside: bool = False) -> DataFrame:
    rows = metrics.where((F.col("strategy") == speculative) & F.col("window_end").isNotNull())
    if not include_outside:
        rows = without_outside(rows)
    return final_versions(rows, ["window_end", "zone_id"], "event_count")


def baseline(finals: DataFrame, count: str) -> DataFrame:
    """One row: mean final event count per window."""
    return finals.agg(F.avg(zero_if_missing(F.col(count))).alias("baseline"))


def _completeness(avg: Column, reference: Column, is_reference: Column) -> Column:
    share = F.least(F.lit(100.0), avg / reference * 100)
    return (F.when(F.coalesce(reference, F.lit(0.0)) <= 0, avg)
            .when(is_reference, F.lit(100.0)).otherwise(share))


# Global means and trade-off -------------------------------------------------

def house_means(metrics: DataFrame) -> DataFrame:
    return without_initial(metrics).groupBy("strategy").agg(
        zero_if_missing(F.avg("true_latency_ms") / 1000.0).alias("true_latency_s"),
        zero_if_missing(F.avg("decisional_latency_ms") / 1000.0).alias("decisional_latency_s"),
        zero_if_missing(F.avg("pachete_count")).alias("avg_events"),
        zero_if_missing(F.avg("update_count")).alias("overhead"))


def taxi_means(metrics: DataFrame) -> DataFrame:
    """Includes the cell outside the grid, unlike the baseline it is compared with."""
    return metrics.where(F.col("window_delay_s") < MAX_DELAY_S).groupBy("strategy").agg(
        zero_if_missing(F.avg("true_latency_ms") / 1000.0).alias("true_latency_s"),
        zero_if_missing(F.avg("window_delay_s") / 60.0).alias("window_delay_min"),
        zero_if_missing(F.avg("event_count")).alias("avg_events"),
        zero_if_missing(F.avg("avg_distance")).alias("avg_distance"),
        zero_if_missing(F.avg("avg_duration")).alias("avg_duration"),
        zero_if_missing(F.avg("update_count")).alias("overhead"))


def with_completeness(means: DataFrame, reference: DataFrame, speculative: str) -> DataFrame:
    value = _completeness(F.col("avg_events"), reference.scalar(), F.col("strategy") == speculative)
    return means.withColumn("completeness_pct", value)


def house_comparison(metrics: DataFrame, speculative: str = "speculative",
                     labels: dict[str, str] | None = None) -> DataFrame:
    reference = baseline(house_finals(metrics, speculative), "pachete_count")
    out = with_completeness(house_means(metrics), reference, speculative)
    return out.withColumn("label", label_of(F.col("strategy"), labels or {}))


def taxi_comparison(metrics: DataFrame, speculative: str = "taxi_speculative_m3",
                    labels: dict[str, str] | None = None) -> DataFrame:
    reference = baseline(taxi_finals(metrics, speculative), "event_count")
    out = with_completeness(taxi_means(metrics), reference, speculative)
    return out.withColumn("label", label_of(F.col("strategy"), labels or {}))


def tradeoff(comparison: DataFrame) -> DataFrame:
    return comparison.select("strategy", "true_latency_s", "completeness_pct")


# Completeness over time -----------------------------------------------------

def _series(rows: DataFrame, key: str, count: str, bucket: str, per_key) -> DataFrame:
    """Two-level aggregate: per bucket and key, then the mean over keys. Empty buckets have no row."""
    return (rows.where(F.col(count).isNotNull())
            .groupBy("strategy", F.window("time", bucket).alias("_w"), key)
            .agg(per_key(count).alias("_v"))
            .groupBy("strategy", F.unix_millis("_w.start").alias("bucket_ms"))
            .agg(F.avg("_v").alias("avg_events")))


def house_series(metrics: DataFrame, bucket: str = "1 minute") -> DataFrame:
    return _series(without_initial(metrics), "house_id", "pachete_count", bucket, F.avg)


def taxi_series(metrics: DataFrame, bucket: str = "2 minutes") -> DataFrame:
    return _series(without_outside(metrics), "zone_id", "event_count", bucket, F.max)


def series_completeness(series: DataFrame, speculative: str) -> DataFrame:
    """Each strategy's series as a percentage of the speculative one in the same bucket."""
    reference = series.where(F.col("strategy") == speculative) \
        .select("bucket_ms", F.col("avg_events").alias("reference_events"))
    share = F.least(F.lit(100.0), F.col("avg_events") / F.col("reference_events") * 100)
    return (series.where(F.col("strategy") != speculative).join(reference, "bucket_ms", "left")
            .withColumn("completeness_pct", share)
            .where(F.col("completeness_pct").isNotNull())
            .select("strategy", "bucket_ms", "avg_events", "reference_events", "completeness_pct"))


# Per key --------------------------------------------------------------------

def house_events(metrics: DataFrame) -> DataFrame:
    return without_initial(metrics).groupBy("strategy", "house_id").agg(F.avg("pachete_count").alias("avg_events"))


def zone_events(metrics: DataFrame) -> DataFrame:
    return without_outside(metrics).groupBy("strategy", "zone_id").agg(F.avg("event_count").alias("avg_events"))


def final_events_per_key(finals: DataFrame, key: str, count: str) -> DataFrame:
    return finals.groupBy(key).agg(F.avg(zero_if_missing(F.col(count))).alias("reference_events"))


def _every_key(means: DataFrame, reference: DataFrame, key: str, speculative: str) -> DataFrame:
    """Reference keys for every other strategy, with the strategy's own values where it has any.

    The strategies present ride along as one array per reference key, so a key a strategy lost keeps
    its row.
    """
    names = means.where(F.col("strategy") != speculative).agg(
        F.sort_array(F.collect_set("strategy")).alias("_names"))
    full = reference.withColumn("strategy", F.explode(names.scalar()))
    return full.join(means, ["strategy", key], "left")


def _grid_share() -> Column:
    return F.when(F.col("reference_events") > 0,
                  F.least(F.lit(100.0), zero_if_missing(F.col("avg_events")) / F.col("reference_events") * 100)
                  ).otherwise(F.lit(0.0))


def house_grid(metrics: DataFrame, speculative: str = "speculative") -> DataFrame:
    """Completeness per house on the 10 x 10 house grid, long form."""
    reference = final_events_per_key(house_finals(metrics, speculative), "house_id", "pachete_count")
    row, column = house_cell(F.col("house_id"))
    return (_every_key(house_events(metrics), reference, "house_id", speculative)
            .withColumn("grid_row", F.lit(GRID_CELLS - 1) - row).withColumn("grid_col", column)
            .where((F.col("grid_row") >= 0) & (F.col("grid_row") < GRID_CELLS))
            .select("strategy", "house_id", "grid_row", "grid_col", _grid_share().alias("completeness_pct")))


def _inside() -> Column:
    return (F.col("_x") >= 0) & (F.col("_x") < GRID_CELLS) & (F.col("_y") >= 0) & (F.col("_y") < GRID_CELLS)


def zone_grid(metrics: DataFrame, speculative: str = "taxi_speculative_m3") -> DataFrame:
    """Completeness per taxi zone; north is at the top, cells with index 10 fall off the grid."""
    reference = final_events_per_key(taxi_finals(metrics, speculative), "zone_id", "event_count")
    x, y = zone_cell(F.col("zone_id"))
    return (_every_key(zone_events(metrics), reference, "zone_id", speculative)
            .withColumn("_x", x).withColumn("_y", y).where(_inside())
            .select("strategy", "zone_id", (F.lit(GRID_CELLS - 1) - F.col("_y")).alias("grid_row"),
                    F.col("_x").alias("grid_col"), _grid_share().alias("completeness_pct")))


def as_matrix(grid: DataFrame) -> DataFrame:
    """Grid rows with one column per grid column."""
    return (grid.groupBy("strategy", "grid_row").pivot("grid_col", list(range(GRID_CELLS)))
            .agg(F.max("completeness_pct")))


# Statistical error ----------------------------------------------------------

def _signed_error(value: str, reference: Column, is_reference: Column, valid: Column) -> Column:
    return F.when(valid, F.when(is_reference, F.lit(0.0))
                  .otherwise((F.col(value) - reference) / reference * 100))


def house_errors(metrics: DataFrame, speculative: str = "speculative") -> DataFrame:
    """Signed error of the mean temperature and energy against the speculative means."""
    means = (without_initial(metrics).groupBy("strategy")
             .agg(F.avg("avg_temp").alias("mean_temp"),
                  zero_if_missing(F.avg("avg_energy")).alias("mean_energy"))
             .where(F.col("mean_temp").isNotNull()))
    reference = means.where(F.col("strategy") == speculative)
    temp, energy = reference.select("mean_temp").scalar(), reference.select("mean_energy").scalar()
    me, valid = F.col("strategy") == speculative, (temp > 0) & (energy > 0)
    return means.select("strategy", "mean_temp", "mean_energy",
                        _signed_error("mean_temp", temp, me, valid).alias("temp_error_pct"),
                        _signed_error("mean_energy", energy, me, valid).alias("energy_error_pct"))


def taxi_errors(metrics: DataFrame, speculative: str = "taxi_speculative_m3") -> DataFrame:
    """Signed error of mean distance and duration against the final speculative versions."""
    reference = taxi_finals(metrics, speculative).agg(
        F.avg(zero_if_missing(F.col("avg_distance"))).alias("d"),
        F.avg(zero_if_missing(F.col("avg_duration"))).alias("t"))
    distance, duration = reference.select("d").scalar(), reference.select("t").scalar()
    me, valid = F.col("strategy") == speculative, (distance > 0) & (duration > 0)
    return taxi_means(metrics).select(
        "strategy", "avg_distance", "avg_duration",
        _signed_error("avg_distance", distance, me, valid).alias("distance_error_pct"),
        _signed_error("avg_duration", duration, me, valid).alias("duration_error_pct"))


def zone_errors(metrics: DataFrame, speculative: str = "taxi_speculative_m3") -> DataFrame:
    """Absolute error per zone, at most 100; a missing value or zero reference counts as 100."""
    reference = (taxi_finals(metrics, speculative).groupBy("zone_id")
                 .agg(F.avg(zero_if_missing(F.col("avg_distance"))).alias("ref_distance"),
                      F.avg(zero_if_missing(F.col("avg_duration"))).alias("ref_duration")))
    means = (without_outside(metrics).groupBy("strategy", "zone_id")
             .agg(F.avg("avg_distance").alias("distance"),
                  zero_if_missing(F.avg("avg_duration")).alias("duration"))
             .where(F.col("distance").isNotNull()))
    x, y = zone_cell(F.col("zone_id"))

    def error(value: str, ref: str) -> Column:
        share = F.when(F.col(ref) > 0, F.abs(F.col(value) - F.col(ref)) / F.col(ref) * 100)
        return F.least(F.lit(100.0), F.coalesce(share, F.lit(100.0)))

    return (_every_key(means, reference, "zone_id", speculative)
            .withColumn("_x", x).withColumn("_y", y).where(_inside())
            .select("strategy", "zone_id", (F.lit(GRID_CELLS - 1) - F.col("_y")).alias("grid_row"),
                    F.col("_x").alias("grid_col"),
                    error("distance", "ref_distance").alias("distance_error_pct"),
                    error("duration", "ref_duration").alias("duration_error_pct")))


# Interval monitor -----------------------------------------------------------

def monitor(metrics: DataFrame, speculative: str = "taxi_speculative_m3", interval: str = "10 minutes",
            mode: int = 3) -> DataFrame:
    """Report per interval of write time and strategy, against the speculative mean of that interval.

    The reference averages every speculative update, and the cell outside the grid counts here.
    Intervals without speculative rows are not reported.
    """
    per = (metrics.groupBy(F.window("time", interval).alias("_w"), "strategy")
           .agg(zero_if_missing(F.avg("event_count")).alias("avg_events"),
                zero_if_missing(F.avg("true_latency_ms") / 1000.0).alias("avg_latency_s"),
                F.count("event_count").alias("windows_fired"))
           .withColumn("interval_end_ms", F.unix_millis("_w.end")).drop("_w"))
    return _monitor_report(per, speculative, mode)


def monitor_latest(metrics: DataFrame, now: Column, speculative: str = "taxi_speculative_m3",
                   interval: str = "10 minutes", mode: int = 3) -> DataFrame:
    """The same report for the interval that ends at ``now``."""
    per = (since(metrics, now, interval).groupBy("strategy")
           .agg(zero_if_missing(F.avg("event_count")).alias("avg_events"),
                zero_if_missing(F.avg("true_latency_ms") / 1000.0).alias("avg_latency_s"),
                F.count("event_count").alias("windows_fired"))
           .withColumn("interval_end_ms", F.unix_millis(now)))
    return _monitor_report(per, speculative, mode)


def _monitor_report(per: DataFrame, speculative: str, mode: int) -> DataFrame:
    reference = per.where((F.col("strategy") == speculative) & (F.col("avg_events") > 0)) \
        .select("interval_end_ms", F.col("avg_events").alias("_ref"))
    me = F.col("strategy") == speculative
    share = F.least(F.lit(100.0), F.col("avg_events") / F.col("_ref") * 100)
    lost = F.greatest(F.lit(0.0), F.col("_ref") - F.col("avg_events"))
    return per.join(reference, "interval_end_ms").select(
        "interval_end_ms", F.lit(mode).alias("mode"), "strategy",
        F.when(me, F.lit(100.0)).otherwise(share).alias("completeness_pct"), "avg_events",
        F.when(me, F.lit(0.0)).otherwise(lost).alias("lost_events_per_window"), "avg_latency_s", "windows_fired")


# Parameter sensitivity ------------------------------------------------------

def house_sensitivity(metrics: DataFrame, events_per_window: float = THEORETICAL_EVENTS) -> DataFrame:
    """Per variant, completeness against the theoretical number of events in a window."""
    share = F.least(F.lit(100.0), F.col("avg_events") / F.lit(events_per_window) * 100)
    return house_means(metrics).select(
        "strategy", "true_latency_s", "decisional_latency_s", share.alias("completeness_pct"), "overhead")


def taxi_sensitivity(metrics: DataFrame, variants: list[str],
                     speculative: str = "taxi_speculative_m3") -> DataFrame:
    """Per variant, completeness against the final speculative mean (outside cell included), or
    against the best variant when there is no speculative run."""
    rows = of_strategies(metrics, variants).groupBy("strategy").agg(
        zero_if_missing(F.avg("true_latency_ms") / 1000.0).alias("true_latency_s"),
        zero_if_missing(F.avg("window_delay_s") / 60.0).alias("window_delay_min"),
        zero_if_missing(F.avg("event_count")).alias("avg_events"))
    spec = baseline(taxi_finals(metrics, speculative, include_outside=True), "event_count").scalar()
    best = rows.agg(F.max("avg_events")).scalar()
    reference = F.when(F.coalesce(spec, F.lit(0.0)) > 0, spec).otherwise(best)
    share = F.when(reference > 0, F.least(F.lit(100.0), F.col("avg_events") / reference * 100)).otherwise(0.0)
    return rows.select("strategy", "true_latency_s", "window_delay_min", share.alias("completeness_pct"))


def rounded_report(report: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round half-even for an exported table."""
    return report.select(*[F.bround(c, digits[c]).alias(c) if c in digits else F.col(c) for c in report.columns])
