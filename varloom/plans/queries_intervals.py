"""Queries on intervals, peaks, distances and signal tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.operators import intervals as iv, tracks
from varloom.operators.variants import outside_genes
from varloom.plans.inputs import EVENT_TYPES, bins, genes, intervals, r6, runs, stored_runs, variants
from varloom.plans.registry import query, view


def _islands(source: str, keys: str, gap: int = 0, count: str = ", count(*) AS n") -> str:
    """SQL islands of ``source`` by the running maximum of earlier ends."""
    return f"""
  SELECT {keys}, min(start) AS start, max("end") AS "end"{count} FROM (
    SELECT *, sum(opens) OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap}
        THEN 0 ELSE 1 END AS opens FROM {source}))
  GROUP BY {keys}, island"""


@query(_islands("intervals", "chrom"))
def merge_intervals(spark, sf):
    return iv.merge_intervals(intervals(spark, sf))


@query(_islands("intervals", "chrom, feature", 600))
def merge_intervals_with_gap(spark, sf):
    return iv.merge_intervals(intervals(spark, sf), ["chrom", "feature"], gap=600)


view("sample_islands", _islands("intervals", "chrom, feature, sample", count=""))
view("segments", """
  SELECT chrom, feature, pos AS start, next_pos AS "end", n FROM (
    SELECT chrom, feature, pos, lead(pos) OVER (PARTITION BY chrom, feature ORDER BY pos) AS next_pos,
           CAST(sum(step) OVER (PARTITION BY chrom, feature ORDER BY pos) AS BIGINT) AS n
    FROM (SELECT chrom, feature, pos, sum(step) AS step FROM (
      SELECT chrom, feature, start AS pos, 1 AS step FROM sample_islands UNION ALL SELECT chrom, feature, "end", -1 FROM sample_islands) GROUP BY ALL))
  WHERE n > 0""")
view("wide_segments", "SELECT feature, chrom, start, \"end\" FROM segments JOIN (SELECT feature, ceil(count(DISTINCT sample) / 2) AS needed FROM intervals GROUP BY feature) USING (feature) WHERE n >= needed")
view("consensus", _islands("wide_segments", "feature, chrom", count=""))


@query("SELECT * FROM segments")
def multi_intersect(spark, sf):
    return iv.multi_intersect(intervals(spark, sf), ["chrom", "feature"])


@query("SELECT * FROM consensus")
def consensus_peaks(spark, sf):
    return iv.consensus(intervals(spark, sf))


view("centres", 'SELECT feature, chrom, (start + "end") // 2 AS start FROM consensus')


@query("SELECT feature, chrom, start, start + 1 AS \"end\" FROM centres")
def peak_centres(spark, sf):
    return iv.centres(iv.consensus(intervals(spark, sf)))


view("merged", _islands("intervals", "chrom"))
view("coverage", """
  SELECT b.chrom, b.start, b."end", coalesce(o.n, 0) AS num_overlaps, coalesce(c.covered, 0) AS bases_covered FROM bins b
  LEFT JOIN (SELECT b.chrom, b.start, count(*) AS n FROM bins b JOIN intervals i ON i.chrom = b.chrom AND i.start < b."end" AND i."end" > b.start GROUP BY ALL) o USING (chrom, start)
  LEFT JOIN (SELECT b.chrom, b.start, CAST(sum(least(b."end", i."end") - greatest(b.start, i.start)) AS BIGINT) AS covered
             FROM bins b JOIN merged i ON i.chrom = b.chrom AND i.start < b."end" AND i."end" > b.start GROUP BY ALL) c USING (chrom, start)""")


@query("""
  SELECT chrom, start, "end", num_overlaps, bases_covered, "end" - start AS interval_length, round(bases_covered / 10000.0, 6) AS fraction_covered,
         round(bases_covered / 100.0, 6) AS percent_covered FROM coverage""")
def coverage(spark, sf):
    c = iv.coverage(bins(spark, sf), intervals(spark, sf))
    return c.withColumns({n: r6(F.col(n)) for n in ("fraction_covered", "percent_covered")}).select(
        "chrom", "start", "end", "num_overlaps", "bases_covered", "interval_length", "fraction_covered", "percent_covered"
    )


@query("""
  SELECT variant_key, chrom, pos FROM variants v WHERE event_type <> 'purchase'
  AND NOT EXISTS (SELECT 1 FROM genes g WHERE g.chrom = v.chrom AND v.pos BETWEEN g.start AND g."end")""")
def variants_outside_genes(spark, sf):
    return outside_genes(variants(spark, sf).filter("event_type <> 'purchase'").select("variant_key", "chrom", "pos"), genes(spark, sf))


view("closest", """
  SELECT a.feature AS anchor, f.feature AS feature, a.chrom, a.start, coalesce(min(abs(b.start - a.start)), -1) AS distance,
         coalesce(arg_min(b.start, (abs(b.start - a.start), b.start)), -1) AS nearest
  FROM centres a JOIN (SELECT DISTINCT feature FROM centres) f ON f.feature <> a.feature
  LEFT JOIN centres b ON b.chrom = a.chrom AND b.feature = f.feature GROUP BY ALL""")


def _closest(spark, sf):
    return iv.nearest_feature(iv.centres(iv.consensus(intervals(spark, sf))), EVENT_TYPES)


@query("SELECT anchor, feature, chrom, start, nearest, distance FROM closest")
def nearest_feature_distances(spark, sf):
    return _closest(spark, sf)


@query("""
  SELECT a.feature, f.feature AS other, a.chrom, a.start, a."end", a.interval_id, coalesce(min(d), -1) AS distance, coalesce(arg_min(b_start, (d, b_start)), -1) AS nearest
  FROM intervals a JOIN (SELECT DISTINCT feature FROM intervals) f ON f.feature <> a.feature
  LEFT JOIN LATERAL (
    SELECT b.start AS b_start, CASE WHEN b.start < a."end" AND b."end" > a.start THEN 0 WHEN b."end" <= a.start THEN a.start - b."end" + 1 ELSE b.start - a."end" + 1 END AS d
    FROM intervals b WHERE b.chrom = a.chrom AND b.feature = f.feature) ON true
  GROUP BY ALL""")
def nearest_intervals(spark, sf):
    """Nearest intervals of all ordered pairs of features, from the raw, overlapping and nested ones."""
    return iv.nearest_intervals(intervals(spark, sf).drop("sample"), EVENT_TYPES)


def _summary_sql(source: str, keys: str, value: str) -> str:
    limits = ", ".join(f"round(avg(CAST(v <= {limit} AS INTEGER)) FILTER (v >= 0), 6) AS {name}" for name, limit in iv.LIMITS.items())
    points = ", ".join(f"round(quantile_cont(v, {p}) FILTER (v >= 0), 6) AS {name}" for name, p in iv.PERCENTILES.items())
    return f"""
  SELECT {keys}, count(*) FILTER (v >= 0) AS count, round(avg(v) FILTER (v >= 0), 6) AS mean, round(stddev_samp(v) FILTER (v >= 0), 6) AS std,
         CAST(min(v) FILTER (v >= 0) AS DOUBLE) AS min, CAST(max(v) FILTER (v >= 0) AS DOUBLE) AS max, {points}, {limits}, count(*) FILTER (v < 0) AS invalid
  FROM (SELECT {keys}, CAST({value} AS DOUBLE) AS v FROM {source}) GROUP BY {keys}"""


def _rounded(summary, keys):
    rounded = ["mean", "std", *iv.PERCENTILES, *iv.LIMITS]
    return summary.withColumns({c: r6(F.col(c)) for c in rounded}).select(*keys, "count", "mean", "std", "min", "max", *iv.PERCENTILES, *iv.LIMITS, "invalid")


@query(_summary_sql("closest", "anchor, feature", "distance"))
def distance_summary(spark, sf):
    return _rounded(iv.distribution_summary(_closest(spark, sf), ["anchor", "feature"], "distance"), ["anchor", "feature"])


@query("SELECT anchor, " + ", ".join(f"CASE WHEN anchor = '{f}' THEN 0 ELSE round(quantile_cont(distance, 0.5) FILTER (feature = '{f}'), 6) END AS {f}" for f in EVENT_TYPES)
       + " FROM (SELECT * FROM closest WHERE distance >= 0) GROUP BY anchor")
def distance_matrix(spark, sf):
    summary = iv.distribution_summary(_closest(spark, sf), ["anchor", "feature"], "distance")
    matrix = iv.statistic_matrix(summary, EVENT_TYPES, "median")
    return matrix.select("anchor", *[r6(F.col(f)).alias(f) for f in EVENT_TYPES])


view("gaps", "SELECT feature, chrom, start, start - lag(start) OVER (PARTITION BY feature, chrom ORDER BY start) AS distance FROM intervals")


@query("SELECT feature, chrom, start, distance, count(*) AS n FROM gaps WHERE distance IS NOT NULL GROUP BY ALL")
def start_distances(spark, sf):
    return iv.start_distances(intervals(spark, sf), ["feature", "chrom"]).groupBy("feature", "chrom", "start", "distance").agg(F.sum("n").alias("n"))


@query(_summary_sql("(SELECT * FROM gaps WHERE distance IS NOT NULL)", "feature", "distance"))
def start_distance_summary(spark, sf):
    gaps = iv.start_distances(intervals(spark, sf), ["feature", "chrom"])
    return _rounded(iv.distribution_summary(gaps, ["feature"], "distance", weight="n"), ["feature"])


@query(_summary_sql('(SELECT feature, "end" - start AS width FROM intervals)', "feature", "width"))
def peak_width_summary(spark, sf):
    widths = intervals(spark, sf).withColumn("width", F.col("end") - F.col("start"))
    return _rounded(iv.distribution_summary(widths, ["feature"], "width"), ["feature"])


# --- peaks -------------------------------------------------------------------------------------

view("high_runs", "SELECT * FROM runs WHERE value >= 60")
view("strong", f"SELECT chrom, start, \"end\" FROM ({_islands('high_runs', 'chrom', 500)}) WHERE \"end\" - start >= 200")
view("low_runs", "SELECT * FROM runs WHERE value >= 30")
view("weak", f"SELECT chrom, start, \"end\" FROM ({_islands('low_runs', 'chrom', 1000)}) WHERE \"end\" - start >= 200")


@query("SELECT * FROM strong")
def call_peaks(spark, sf):
    return iv.call_peaks(runs(spark, sf), 60.0, 500, 200)


@query("""
  SELECT w.chrom, w.start, w."end", count(*) AS n_peaks, CAST(sum(s."end" - s.start) AS BIGINT) AS peak_bases
  FROM weak w JOIN strong s ON s.chrom = w.chrom AND s.start < w."end" AND s."end" > w.start GROUP BY ALL""")
def call_broad_peaks(spark, sf):
    return iv.call_broad_peaks(runs(spark, sf), 60.0, 30.0, 500, 1000, 200)


_CUTOFFS = [20.0, 50.0, 80.0, 120.0]
view("cut_runs", "SELECT c.cutoff, r.* FROM runs r JOIN (VALUES (20.0::DOUBLE), (50.0), (80.0), (120.0)) c(cutoff) ON r.value >= c.cutoff")


@query(f"""
  SELECT cutoff, count(*) AS n_peaks, CAST(sum("end" - start) AS BIGINT) AS total_length, round(avg("end" - start), 6) AS mean_length
  FROM ({_islands('cut_runs', 'cutoff, chrom', 100)}) WHERE "end" - start >= 200 GROUP BY cutoff""")
def cutoff_analysis(spark, sf):
    return iv.cutoff_analysis(runs(spark, sf), _CUTOFFS).withColumn("mean_length", r6(F.col("mean_length")))


view("grid_runs", "SELECT c.cutoff, r.* FROM runs r JOIN (SELECT CAST(c AS DOUBLE) AS cutoff FROM range(2, 202, 2) t(c)) c ON r.value >= c.cutoff")


@query(f"""
  SELECT cutoff, count(*) AS n_peaks, CAST(sum("end" - start) AS BIGINT) AS total_length, round(avg("end" - start), 6) AS mean_length
  FROM ({_islands('grid_runs', 'cutoff, chrom', 100)}) WHERE "end" - start >= 200 GROUP BY cutoff""")
def cutoff_grid(spark, sf):
    """A hundred cutoffs in one reading of the runs."""
    return iv.cutoff_analysis(runs(spark, sf), [2.0 * c for c in range(1, 101)]).withColumn("mean_length", r6(F.col("mean_length")))


# --- tracks ------------------------------------------------------------------------------------


@query('SELECT chrom, max("end") AS length FROM runs GROUP BY chrom')
def track_lengths(spark, sf):
    return tracks.track_lengths(runs(spark, sf))


@query('SELECT * FROM runs WHERE chrom = 3 AND start < 2000000 AND "end" > 500000 AND value > 20')
def runs_in_region(spark, sf):
    return tracks.runs_in_region(runs(spark, sf), 3, 500_000, 2_000_000, above=20.0)


def _regions(spark, sf):
    return intervals(spark, sf).select(F.col("interval_id").alias("region_id"), "chrom", "start", "end")


@query("""
  WITH clipped AS (
    SELECT i.interval_id AS region_id, i.chrom, i.start, i."end", r.value, least(i."end", r."end") - greatest(i.start, r.start) AS bases
    FROM intervals i JOIN runs r ON r.chrom = i.chrom AND r.start < i."end" AND r."end" > i.start)
  SELECT region_id, round(sum(bases * value) / sum(bases), 6) AS mean, min(value) AS min, max(value) AS max, CAST(sum(bases) AS BIGINT) AS covered FROM clipped GROUP BY region_id""")
def region_signal(spark, sf):
    stats = tracks.region_stats(_regions(spark, sf), runs(spark, sf)).filter("coverage > 0")
    covered = F.round(F.col("coverage") * (F.col("end") - F.col("start"))).cast("long")
    return stats.select("region_id", r6(F.col("mean")).alias("mean"), "min", "max", covered.alias("covered"))


@query("""
  SELECT region_id, round(sqrt(sum(bases * (value - mean) ^ 2) / nullif(sum(bases) - 1, 0)), 4) AS std FROM (
    SELECT region_id, value, bases, sum(bases * value) OVER (PARTITION BY region_id) / sum(bases) OVER (PARTITION BY region_id) AS mean FROM (
      SELECT i.interval_id AS region_id, r.value, least(i."end", r."end") - greatest(i.start, r.start) AS bases
      FROM intervals i JOIN runs r ON r.chrom = i.chrom AND r.start < i."end" AND r."end" > i.start)) GROUP BY region_id""")
def region_deviation(spark, sf):
    stats = tracks.region_stats(_regions(spark, sf), runs(spark, sf)).filter("coverage > 0")
    return stats.select("region_id", F.round("std", 4).alias("std"))


@query("""
  SELECT v.variant_key AS region_id, v.chrom, p.pos0, value FROM variants v, LATERAL (SELECT unnest(range(v.pos - 3, v.pos + 2)) AS pos0) p
  LEFT JOIN runs r ON r.chrom = v.chrom AND r.start <= p.pos0 AND r."end" > p.pos0""")
def base_values(spark, sf):
    """The signal at every variant and at two bases on either side of it."""
    sites = variants(spark, sf).select(F.col("variant_key").alias("region_id"), "chrom", (F.col("pos") - 3).alias("start"), (F.col("pos") + 2).alias("end"))
    return tracks.base_values(sites, runs(spark, sf))


_BINS = 400
view("track", f"""
  WITH sized AS (SELECT r.*, l.length FROM runs r JOIN (SELECT chrom, max("end") AS length FROM runs GROUP BY chrom) l USING (chrom)),
  edges AS (SELECT chrom, i AS bin, i * length // {_BINS} AS s, (i + 1) * length // {_BINS} AS e
            FROM (SELECT chrom, max("end") AS length FROM runs GROUP BY chrom), range({_BINS}) t(i))
  SELECT g.chrom, g.bin, ln(1 + coalesce(sum((least(g.e, r."end") - greatest(g.s, r.start)) * r.value) / sum(least(g.e, r."end") - greatest(g.s, r.start)), 0)) AS signal
  FROM edges g LEFT JOIN runs r ON r.chrom = g.chrom AND r.start < g.e AND r."end" > g.s GROUP BY ALL""")


def _track(spark, sf):
    source = stored_runs(spark, sf)
    return tracks.binned_track(source, tracks.track_lengths(source), _BINS)


@query("SELECT chrom, bin, round(signal, 6) AS signal FROM track")
def binned_track(spark, sf):
    return _track(spark, sf).withColumn("signal", r6(F.col("signal")))


# The mirrored index of bin + d is d steps beyond an end, counted back from it.
@query(f"""
  WITH kernel AS (SELECT d, exp(-0.5 * (d / 2.0) ^ 2) AS w FROM range(-8, 9) t(d)),
  reached AS (SELECT g.chrom, g.bin, k.w, CASE WHEN g.bin + d < 0 THEN -1 - (g.bin + d) WHEN g.bin + d >= {_BINS} THEN {2 * _BINS - 1} - (g.bin + d) ELSE g.bin + d END AS source
              FROM track g, kernel k)
  SELECT r.chrom, r.bin, round(sum(r.w * t.signal) / sum(r.w), 6) AS smoothed FROM reached r JOIN track t ON t.chrom = r.chrom AND t.bin = r.source GROUP BY r.chrom, r.bin""")
def smoothed_track(spark, sf):
    return tracks.gaussian_smooth(_track(spark, sf), _BINS, 2.0).withColumn("smoothed", r6(F.col("smoothed")))
