"""Metric queries over the taxi results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbmark import params
from ebbmark.plans import metrics
from ebbmark.session import shared_folder
from ebbmark.sources import sinks
from oracles import base
from registry.core import approx, query, run_taxi, taxi, taxi_log, taxi_metrics

SPEC = "taxi_speculative_m3"
CTES = base.taxi_ctes() + [base.taxi_metrics(SPEC)]
FINALS = [f"""finals AS (SELECT * FROM metrics WHERE strategy = '{SPEC}' AND zone_id <> 'CELL_OUT'
              QUALIFY row_number() OVER (PARTITION BY window_end, zone_id ORDER BY event_count DESC) = 1)""",
          "reference AS (SELECT CAST(sum(event_count) AS DOUBLE) / count(event_count) AS baseline FROM finals)"]
MEANS = """means AS (SELECT strategy, CAST(sum(true_latency_ms) AS DOUBLE) / count(true_latency_ms) / 1000.0 AS true_latency_s,
    avg(window_delay_s) / 60.0 AS window_delay_min, CAST(sum(event_count) AS DOUBLE) / count(event_count) AS avg_events, avg(avg_distance) AS avg_distance,
    avg(avg_duration) AS avg_duration, CAST(sum(update_count) AS DOUBLE) / count(update_count) AS overhead FROM metrics WHERE window_delay_s < 86400 GROUP BY strategy)"""
COMPLETENESS = (f"CASE WHEN baseline <= 0 THEN avg_events WHEN strategy = '{SPEC}' THEN 100.0 "
                "ELSE least(100.0, avg_events / baseline * 100) END AS completeness_pct")
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("window_delay_min", "avg_distance", "avg_duration"))


def sql(final: str, extra: list[str] = ()) -> str:
    return base.statement(CTES + list(extra), final)


@query("taxi_comparison", sql(f"""SELECT strategy, true_latency_s, {ROUNDED}, avg_events, overhead, {COMPLETENESS}
    FROM means, reference""", FINALS + [MEANS]))
def comparison(spark, folder):
    rows = metrics.taxi_comparison(taxi_metrics(spark, folder), SPEC)
    return _rounded(rows)


def _rounded(rows):
    return rows.select("strategy", "true_latency_s", approx("window_delay_min"), approx("avg_distance"),
                       approx("avg_duration"), "avg_events", "overhead", "completeness_pct")


@query("taxi_comparison_without_outliers", sql(f"""SELECT strategy, true_latency_s, {ROUNDED}, avg_events, overhead, {COMPLETENESS}
    FROM means, reference""", FINALS + [MEANS]))
def comparison_without_outliers(spark, folder):
    """The same report from a log that also holds results delayed by a day and more, which it must leave out."""
    rows = taxi_metrics(spark, folder)
    late = rows.where(F.col("strategy") != SPEC).withColumn("window_delay_s", F.col("window_delay_s") + 86_400.0)
    return _rounded(metrics.taxi_comparison(rows.unionByName(late), SPEC))


@query("taxi_metric_log", sql("""SELECT time_ms, zone_id, strategy, true_latency_ms, window_delay_s, event_count, avg_distance,
    avg_duration, update_count, window_end FROM metrics"""))
def metric_log(spark, folder):
    rows = taxi_metrics(spark, folder)
    return rows.select(F.unix_millis("time").alias("time_ms"), *[c for c in rows.columns if c != "time"])


@query("taxi_final_versions", sql("SELECT window_end, zone_id, event_count, avg_distance, avg_duration, update_count FROM finals",
                                  FINALS))
def final_versions(spark, folder):
    return metrics.taxi_finals(taxi_metrics(spark, folder), SPEC).select(
        "window_end", "zone_id", "event_count", "avg_distance", "avg_duration", "update_count")


@query("taxi_speculative_baseline", sql("SELECT baseline FROM reference", FINALS))
def speculative_baseline(spark, folder):
    return metrics.baseline(metrics.taxi_finals(taxi_metrics(spark, folder), SPEC), "event_count")


@query("taxi_tradeoff", sql(f"SELECT strategy, true_latency_s, {COMPLETENESS} FROM means, reference", FINALS + [MEANS]))
def tradeoff(spark, folder):
    return metrics.tradeoff(metrics.taxi_comparison(taxi_metrics(spark, folder), SPEC))


def _series(bucket_ms: int) -> list[str]:
    return [f"""series AS (SELECT strategy, bucket_ms, avg(v) AS avg_events FROM (
        SELECT strategy, time_ms // {bucket_ms} * {bucket_ms} AS bucket_ms, zone_id, max(event_count) AS v FROM metrics
        WHERE zone_id <> 'CELL_OUT' GROUP BY 1, 2, 3) GROUP BY strategy, bucket_ms)"""]


def _series_queries(suffix: str, bucket: str, bucket_ms: int) -> None:
    @query(f"taxi_series_{suffix}", sql("SELECT strategy, bucket_ms, avg_events FROM series", _series(bucket_ms)))
    def series(spark, folder):
        return metrics.taxi_series(taxi_metrics(spark, folder), bucket)

    @query(f"taxi_series_completeness_{suffix}", sql(f"""SELECT s.strategy, s.bucket_ms, s.avg_events,
        r.avg_events AS reference_events, least(100.0, s.avg_events / r.avg_events * 100) AS completeness_pct
        FROM series s JOIN series r ON s.bucket_ms = r.bucket_ms AND r.strategy = '{SPEC}' WHERE s.strategy <> '{SPEC}'""",
                                                     _series(bucket_ms)))
    def completeness(spark, folder):
        return metrics.series_completeness(metrics.taxi_series(taxi_metrics(spark, folder), bucket), SPEC)


_series_queries("2m", "2 minutes", 120_000)
_series_queries("10m", "10 minutes", 600_000)


@query("zone_events", sql("""SELECT strategy, zone_id, CAST(sum(event_count) AS DOUBLE) / count(event_count) AS avg_events FROM metrics
    WHERE zone_id <> 'CELL_OUT' GROUP BY 1, 2"""))
def zone_events(spark, folder):
    return metrics.zone_events(taxi_metrics(spark, folder))


_XY = ("CAST(9 - CAST(split_part(s.zone_id, '_', 3) AS INTEGER) AS INTEGER) AS grid_row, "
       "CAST(split_part(s.zone_id, '_', 2) AS INTEGER) AS grid_col")
_INSIDE = "CAST(split_part(s.zone_id, '_', 3) AS INTEGER) < 10 AND CAST(split_part(s.zone_id, '_', 2) AS INTEGER) < 10"
_NAMES = f"names AS (SELECT DISTINCT strategy FROM metrics WHERE strategy <> '{SPEC}')"


@query("zone_grid", sql(f"""SELECT n.strategy, s.zone_id, {_XY},
    CASE WHEN ref > 0 THEN least(100.0, coalesce(v, 0) / ref * 100) ELSE 0 END AS completeness_pct
    FROM (SELECT zone_id, CAST(sum(event_count) AS DOUBLE) / count(event_count) AS ref FROM finals GROUP BY zone_id) s CROSS JOIN names n
    LEFT JOIN (SELECT strategy, zone_id, CAST(sum(event_count) AS DOUBLE) / count(event_count) AS v FROM metrics GROUP BY 1, 2) o
    ON o.strategy = n.strategy AND o.zone_id = s.zone_id WHERE {_INSIDE}""", FINALS + [_NAMES]))
def zone_grid(spark, folder):
    return metrics.zone_grid(taxi_metrics(spark, folder), SPEC)


def _error(value: str, ref: str) -> str:
    return f"round(least(100.0, coalesce(CASE WHEN {ref} > 0 THEN abs({value} - {ref}) / {ref} * 100 END, 100.0)), 6)"


@query("zone_errors", sql(f"""SELECT n.strategy, s.zone_id, {_XY}, {_error('d', 'rd')} AS distance_error_pct,
    {_error('t', 'rt')} AS duration_error_pct
    FROM (SELECT zone_id, avg(avg_distance) AS rd, avg(avg_duration) AS rt FROM finals GROUP BY zone_id) s CROSS JOIN names n
    LEFT JOIN (SELECT strategy, zone_id, avg(avg_distance) AS d, avg(avg_duration) AS t FROM metrics GROUP BY 1, 2) o
    ON o.strategy = n.strategy AND o.zone_id = s.zone_id WHERE {_INSIDE}""", FINALS + [_NAMES]))
def zone_errors(spark, folder):
    rows = metrics.zone_errors(taxi_metrics(spark, folder), SPEC)
    return rows.select("strategy", "zone_id", "grid_row", "grid_col", approx("distance_error_pct"),
                       approx("duration_error_pct"))


@query("taxi_errors", sql(f"""SELECT strategy, round(avg_distance, 6) AS avg_distance, round(avg_duration, 6) AS avg_duration,
    round(CASE WHEN strategy = '{SPEC}' THEN 0.0 ELSE (avg_distance - d) / d * 100 END, 6) AS distance_error_pct,
    round(CASE WHEN strategy = '{SPEC}' THEN 0.0 ELSE (avg_duration - t) / t * 100 END, 6) AS duration_error_pct
    FROM means, (SELECT avg(avg_distance) AS d, avg(avg_duration) AS t FROM finals)""", FINALS + [MEANS]))
def errors(spark, folder):
    rows = metrics.taxi_errors(taxi_metrics(spark, folder), SPEC)
    return rows.select("strategy", *[approx(c) for c in rows.columns if c != "strategy"])


def _monitor_sql(groups: str, end: str) -> tuple[list[str], str]:
    per = f"""per AS (SELECT {end} AS interval_end_ms, strategy, CAST(sum(event_count) AS DOUBLE) / count(event_count) AS avg_events,
        CAST(sum(true_latency_ms) AS DOUBLE) / count(true_latency_ms) / 1000.0 AS avg_latency_s, count(*) AS windows_fired FROM {groups} GROUP BY 1, 2)"""
    final = f"""SELECT p.interval_end_ms, CAST(3 AS INTEGER) AS mode, p.strategy,
        CASE WHEN p.strategy = '{SPEC}' THEN 100.0 ELSE least(100.0, p.avg_events / r.avg_events * 100) END AS completeness_pct,
        p.avg_events, CASE WHEN p.strategy = '{SPEC}' THEN 0.0 ELSE greatest(0.0, r.avg_events - p.avg_events) END
        AS lost_events_per_window, p.avg_latency_s, p.windows_fired
        FROM per p JOIN per r ON p.interval_end_ms = r.interval_end_ms AND r.strategy = '{SPEC}'"""
    return [per], final


_PER, _REPORT = _monitor_sql("metrics", "(time_ms // 600000 + 1) * 600000")


@query("taxi_monitor", sql(_REPORT, _PER))
def monitor(spark, folder):
    return metrics.monitor(taxi_metrics(spark, folder), SPEC)


_LATEST_PER, _ = _monitor_sql("(SELECT * FROM metrics WHERE time_ms > (SELECT max(time_ms) FROM metrics) - 600000)",
                              "(SELECT max(time_ms) FROM metrics)")


@query("taxi_monitor_latest", sql(_REPORT, _LATEST_PER))
def monitor_latest(spark, folder):
    rows = taxi_metrics(spark, folder)
    return metrics.monitor_latest(rows, rows.agg(F.max("time")).scalar(), SPEC)


@query("taxi_monitor_log", sql(_REPORT, _PER))
def monitor_log(spark, folder):
    """Interval reports appended to a CSV log and read back."""
    report = metrics.monitor(taxi_metrics(spark, folder), SPEC)
    path = shared_folder(spark, "monitor-log")
    middle = F.lit(1_704_090_000_000)
    for part in (report.where(F.col("interval_end_ms") < middle), report.where(F.col("interval_end_ms") >= middle)):
        sinks.export_report(part, path, "append")
    return spark.read.csv(path, header=True, schema=report.schema)


ADAPTIVE = params.taxi_sensitivity()["adwin"]
STUDY = ([base.fixed(f"taxi_watermark_m3_s{s}", s * 1000) for s in params.TAXI_SLACKS_S]
         + [base.mean_shift(f"taxi_adaptive_adwin_m3_dt{t}", 600_000, t * 1000, 60_000, 10_000, 3_600_000)
            for t in params.TAXI_THRESHOLDS_S]
         + [base.combined(s, 25) for s in ADAPTIVE]
         + [base.fixed(SPEC, 0)])
_STUDY_FINAL = f"""SELECT strategy, CAST(sum(true_latency_ms) AS DOUBLE) / count(true_latency_ms) / 1000.0 AS true_latency_s,
    round(avg(window_delay_s) / 60.0, 6) AS window_delay_min, least(100.0, CAST(sum(event_count) AS DOUBLE) / count(event_count) /
    (SELECT avg(c) FROM (SELECT max(event_count) AS c FROM metrics WHERE strategy = '{SPEC}' GROUP BY window_end, zone_id)) * 100)
    AS completeness_pct FROM metrics WHERE strategy <> '{SPEC}' GROUP BY strategy"""


@query("taxi_sensitivity", base.statement(base.taxi_ctes(STUDY, adaptive=ADAPTIVE) + [base.taxi_metrics(SPEC)], _STUDY_FINAL))
def sensitivity(spark, folder):
    variants = [s for members in params.taxi_sensitivity().values() for s in members]
    log = taxi_log(run_taxi(spark, folder, variants + [params.taxi_speculative(3)]), taxi(spark, folder),
                   params.taxi_speculative(3))
    rows = metrics.taxi_sensitivity(log, [s.name for s in variants], SPEC)
    return rows.select("strategy", "true_latency_s", approx("window_delay_min"), "completeness_pct")


@query("taxi_sensitivity_without_reference", base.statement(
    base.taxi_ctes(STUDY[:5] + STUDY[-1:]) + [base.taxi_metrics(SPEC)],
    f"""SELECT strategy, CAST(sum(true_latency_ms) AS DOUBLE) / count(true_latency_ms) / 1000.0 AS true_latency_s, round(avg(window_delay_s) / 60.0, 6) AS window_delay_min,
    CAST(sum(event_count) AS DOUBLE) / count(event_count) / max(avg(event_count)) OVER () * 100 AS completeness_pct FROM metrics WHERE strategy <> '{SPEC}' GROUP BY strategy"""))
def sensitivity_without_reference(spark, folder):
    """No speculative run: the best variant is the reference."""
    variants = params.taxi_sensitivity()["slack"]
    log = metrics.to_taxi_metrics(run_taxi(spark, folder, variants).windows)
    rows = metrics.taxi_sensitivity(log, [s.name for s in variants], SPEC)
    return rows.select("strategy", "true_latency_s", approx("window_delay_min"), "completeness_pct")


@query("taxi_sensitivity_all_variants", base.statement(
    base.taxi_ctes(STUDY, adaptive=ADAPTIVE) + [base.taxi_metrics(SPEC), f"study AS ({_STUDY_FINAL})"],
    """SELECT strategy, round_even(true_latency_s, 3) AS true_latency_s, round_even(window_delay_min, 2) AS window_delay_min,
    round_even(completeness_pct, 1) AS completeness_pct FROM study"""))
def all_variants(spark, folder):
    """The exported table of the study."""
    variants = [s for members in params.taxi_sensitivity().values() for s in members]
    log = taxi_log(run_taxi(spark, folder, variants + [params.taxi_speculative(3)]), taxi(spark, folder),
                   params.taxi_speculative(3))
    report = metrics.taxi_sensitivity(log, [s.name for s in variants], SPEC)
    return metrics.rounded_report(report, {"true_latency_s": 3, "window_delay_min": 2, "completeness_pct": 1})
