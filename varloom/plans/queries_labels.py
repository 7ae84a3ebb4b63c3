"""Queries on sample labels, prevalence, co-occurrence, splits and subsamples."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.operators import labels, sampling
from varloom.operators.scale import hash_rank
from varloom.operators.variants import sample_exact, sample_per_chromosome
from varloom.plans.inputs import (
    EVENT_TYPES, FEATURES, bins, intervals, labeled_documents, labeled_vectors, prevalence, r6, table, variants,
)
from varloom.plans.registry import query, view

# --- labels ------------------------------------------------------------------------------------


view("sample_merged", """
  SELECT feature, sample, chrom, min(start) AS start, max("end") AS "end" FROM (
    SELECT *, sum(opens) OVER (PARTITION BY feature, sample, chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY feature, sample, chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        THEN 0 ELSE 1 END AS opens FROM intervals)) GROUP BY feature, sample, chrom, island""")
view("bin_labels", """
  SELECT b.chrom, b.start, b."end", g.feature, g.sample, CAST(coalesce(c.covered, 0) / 100.0 >= 50 AS INTEGER) AS label
  FROM bins b CROSS JOIN (SELECT DISTINCT feature, sample FROM intervals) g
  LEFT JOIN (SELECT m.feature, m.sample, b.chrom, b.start, sum(least(b."end", m."end") - greatest(b.start, m.start)) AS covered
             FROM bins b JOIN sample_merged m ON m.chrom = b.chrom AND m.start < b."end" AND m."end" > b.start GROUP BY ALL) c
    ON c.feature = g.feature AND c.sample = g.sample AND c.chrom = b.chrom AND c.start = b.start""")


def _positives(spark, sf):
    return labels.positive_bins(bins(spark, sf), intervals(spark, sf), cell=10_000)


def _prevalence(spark, sf):
    return labels.track_prevalence(bins(spark, sf), _positives(spark, sf), intervals(spark, sf))


@query("SELECT feature, sample, CAST(sum(label) AS BIGINT) AS positive, count(*) AS total, round(avg(label), 6) AS prevalence FROM bin_labels GROUP BY ALL")
def sample_prevalence(spark, sf):
    return _prevalence(spark, sf).withColumn("prevalence", r6(F.col("prevalence")))


view("majority", """
  SELECT feature, chrom, start, "end", CAST(sum(label) >= 0.5 * count(*) AS INTEGER) AS label FROM bin_labels GROUP BY ALL""")


def _majority(spark, sf, source=None):
    source = intervals(spark, sf) if source is None else source
    positives = labels.positive_bins(bins(spark, sf), source, cell=10_000)
    wide = labels.add_majority(bins(spark, sf), positives, labels.replicates(source.select("feature", "sample")), EVENT_TYPES)
    return labels.long_labels(wide, EVENT_TYPES)


# Features with one, two and three samples.
_FEWER = "NOT (feature = 'click' AND sample = 2) AND NOT (feature = 'view' AND sample > 0)"


@query(f"""
  SELECT feature, chrom, start, "end", CAST(sum(label) >= 0.5 * count(*) AS INTEGER) AS label FROM bin_labels WHERE {_FEWER} GROUP BY ALL""")
def majority_of_unequal_samples(spark, sf):
    return _majority(spark, sf, intervals(spark, sf).filter(_FEWER))


@query("SELECT feature, chrom, start, \"end\", label FROM majority")
def majority_labels(spark, sf):
    return _majority(spark, sf)


@query("""
  SELECT CAST(sample AS VARCHAR) AS sample, CAST(sum(label) AS BIGINT) AS positive, count(*) AS total, round(avg(label), 6) AS prevalence FROM bin_labels GROUP BY sample
  UNION ALL SELECT 'majority', CAST(sum(label) AS BIGINT), count(*), round(avg(label), 6) FROM majority""")
def label_stats(spark, sf):
    return labels.label_stats(_prevalence(spark, sf), _majority(spark, sf)).withColumn("prevalence", r6(F.col("prevalence")))


@query("SELECT chrom, start, \"end\", " + ", ".join(f"max(label) FILTER (feature = '{f}') AS {f}" for f in EVENT_TYPES) + " FROM majority GROUP BY ALL")
def merged_samples(spark, sf):
    return labels.merge_labels(bins(spark, sf), _majority(spark, sf), EVENT_TYPES)


# --- prevalence --------------------------------------------------------------------------------


@query("SELECT chrom, feature, ones, zeros, round(ratio, 6) AS ratio FROM prevalence")
def column_prevalence(spark, sf):
    return prevalence(spark, sf).withColumn("ratio", r6(F.col("ratio")))


_LANGS = ["de", "en", "es", "fr"]


@query("SELECT feature, " + ", ".join(f"round(max(ratio) FILTER (chrom = '{l}'), 6) AS {l}" for l in _LANGS) + " FROM prevalence GROUP BY feature")
def prevalence_matrix(spark, sf):
    m = labels.prevalence_matrix(prevalence(spark, sf), _LANGS)
    return m.select("feature", *[r6(F.col(l)).alias(l) for l in _LANGS])


@query("""
  SELECT feature, 'Chr' || chrom AS chrom, CAST(sum(y) AS BIGINT) AS ones, count(*) FILTER (y = 0) AS zeros, round(avg(y), 6) AS ratio FROM labels_long GROUP BY feature, chrom""")
def prevalence_per_feature(spark, sf):
    from varloom.functions.naming import chromosome_order, number_to_name

    rows = labels.column_prevalence(labeled_vectors(spark, sf), FEATURES, ["chrom"]).withColumn("chrom", number_to_name(F.col("chrom")))
    return rows.orderBy("feature", *chromosome_order(F.col("chrom"))).select("feature", "chrom", "ones", "zeros", r6(F.col("ratio")).alias("ratio"))


@query("""
  SELECT CASE WHEN grouping(feature) = 0 THEN 'feature' WHEN grouping(chrom) = 0 THEN 'chrom' ELSE 'global' END AS level, feature, chrom,
         CAST(sum(ones) AS BIGINT) AS ones, CAST(sum(zeros) AS BIGINT) AS zeros, CAST(sum(ones) + sum(zeros) AS BIGINT) AS total, round(sum(ones) / (sum(ones) + sum(zeros)), 6) AS ratio
  FROM prevalence GROUP BY GROUPING SETS ((feature), (chrom), ())""")
def prevalence_totals(spark, sf):
    t = labels.prevalence_totals(prevalence(spark, sf))
    return t.select("level", "feature", "chrom", "ones", "zeros", "total", r6(F.col("ratio")).alias("ratio"))


@query("""
  SELECT chrom, feature, 'Positive' AS label, ones AS count, round(ratio * 100, 6) AS percent FROM prevalence
  UNION ALL SELECT chrom, feature, 'Negative', zeros, round(100 - ratio * 100, 6) FROM prevalence""")
def label_counts_long(spark, sf):
    return labels.label_counts_long(prevalence(spark, sf)).select("chrom", "feature", "label", "count", r6(F.col("percent")).alias("percent"))


# --- co-occurrence -----------------------------------------------------------------------------

view("together", """
  SELECT a.chrom, a.feature AS feature_a, b.feature AS feature_b, CAST(sum(a.y * b.y) AS BIGINT) AS n FROM labels_long a JOIN labels_long b USING (row_id) GROUP BY ALL""")


def _cooccurrence(spark, sf, group=("chrom",)):
    return labels.cooccurrence(labeled_vectors(spark, sf), FEATURES, group)


@query("SELECT chrom, feature_a, feature_b, n FROM together")
def cooccurrence(spark, sf):
    return _cooccurrence(spark, sf)


@query("SELECT feature_a, feature_b, CAST(sum(n) AS BIGINT) AS n FROM together GROUP BY ALL")
def cooccurrence_total(spark, sf):
    return labels.sum_matrices(_cooccurrence(spark, sf))


@query("""
  SELECT count(*) AS differences FROM (
    (SELECT feature_a, feature_b, CAST(sum(n) AS BIGINT) AS n FROM together GROUP BY ALL)
    EXCEPT ALL SELECT a.feature, b.feature, CAST(sum(a.y * b.y) AS BIGINT) FROM labels_long a JOIN labels_long b USING (row_id) GROUP BY ALL)""")
def cooccurrence_differences(spark, sf):
    whole = labels.cooccurrence(labeled_vectors(spark, sf), FEATURES)
    return labels.matrix_differences(labels.sum_matrices(_cooccurrence(spark, sf)), whole).agg(F.count(F.lit(1)).alias("differences"))


@query("""
  SELECT chrom, feature_a, feature_b, n, round(n / nullif(sum(n) OVER (PARTITION BY chrom, feature_a), 0), 6) AS share, round(ln(1 + n), 6) AS log1p FROM together""")
def cooccurrence_normalised(spark, sf):
    m = labels.normalised_matrix(_cooccurrence(spark, sf), ["chrom"])
    return m.select("chrom", "feature_a", "feature_b", "n", r6(F.col("share")).alias("share"), r6(F.col("log1p")).alias("log1p"))


@query("SELECT feature_a, round(avg(n), 6) AS mean FROM together GROUP BY feature_a")
def matrix_row_order(spark, sf):
    return labels.ordered_rows(_cooccurrence(spark, sf), "feature_a", "n").withColumn("mean", r6(F.col("mean")))


@query("SELECT round(quantile_cont(n, 0.05), 6) AS p05, round(quantile_cont(n, 0.95), 6) AS p95 FROM together")
def matrix_colour_limits(spark, sf):
    return labels.colour_limits(_cooccurrence(spark, sf), "n").select(r6(F.col("p05")).alias("p05"), r6(F.col("p95")).alias("p95"))


# --- splits ------------------------------------------------------------------------------------

view("event_rank", """
  SELECT variant_key, chrom, row_number() OVER (PARTITION BY chrom ORDER BY md5('42:' || variant_key), variant_key) AS rank, count(*) OVER (PARTITION BY chrom) AS size FROM variants""")
view("event_split", """
  SELECT variant_key, chrom, CASE WHEN rank <= ceil(size * 0.2::DOUBLE) THEN 'test'
    WHEN rank <= ceil(size * 0.2::DOUBLE) + ceil((size - ceil(size * 0.2::DOUBLE)) * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM event_rank""")


def _split(spark, sf):
    return sampling.random_split(variants(spark, sf).select("variant_key", "chrom"), ["variant_key"])


@query("SELECT variant_key, chrom, split FROM event_split")
def random_split(spark, sf):
    return _split(spark, sf)


@query("""
  SELECT chrom, count(*) AS orig_size, count(*) FILTER (split = 'train') AS train_cnt, count(*) FILTER (split = 'val') AS val_cnt, count(*) FILTER (split = 'test') AS test_cnt
  FROM event_split GROUP BY chrom""")
def split_stats(spark, sf):
    return sampling.split_stats(_split(spark, sf))


def _dealt(name: str, folds: str, n_folds: int) -> None:
    """Views that deal the label sets of each chromosome; ``folds`` lists the fold sizes for ``size`` rows. The last view has the takes."""
    n, each = len(FEATURES), ", ".join(str(f) for f in range(n_folds))
    view(f"{name}_sets", f"""
      SELECT chrom, sig, bits, rows, size, folds, list_transform(folds, lambda f: rows * f // size) AS floors
      FROM (SELECT chrom, {" || '|' || ".join(FEATURES)} AS sig, any_value([{", ".join(FEATURES)}]) AS bits, count(*) AS rows FROM labeled_vectors GROUP BY ALL)
      JOIN (SELECT chrom, size, {folds} AS folds FROM quota_table) USING (chrom)""")
    view(f"{name}_ones", f"SELECT chrom, l, CAST(sum(rows) AS BIGINT) AS ones FROM {name}_sets, range({n}) t(l) WHERE bits[l + 1] = 1 GROUP BY ALL")
    view(f"{name}_room", f"""
      SELECT chrom, list(room ORDER BY f) AS room
      FROM (SELECT chrom, f, CAST(any_value(folds[f + 1]) - sum(floors[f + 1]) AS BIGINT) AS room FROM {name}_sets, range({n_folds}) t(f) GROUP BY chrom, f) GROUP BY chrom""")
    view(f"{name}_lacks", f"""
      SELECT chrom, list(lack ORDER BY f, l) AS lacks
      FROM (SELECT chrom, f, l, CAST(sum(bits[l + 1] * (rows * folds[f + 1] - size * floors[f + 1])) AS BIGINT) AS lack
            FROM {name}_sets, range({n_folds}) t(f), range({n}) u(l) GROUP BY chrom, f, l) GROUP BY chrom""")
    view(f"{name}_rarest", f"""
      SELECT s.chrom, s.sig, arg_min(o.l, (o.ones, o.l)) AS l, min(o.ones) AS ones FROM {name}_sets s JOIN {name}_ones o ON o.chrom = s.chrom AND s.bits[o.l + 1] = 1 GROUP BY ALL""")
    view(f"{name}_rest", f"""
      SELECT chrom, sig, bits, size, l, row_number() OVER (PARTITION BY chrom ORDER BY ones NULLS LAST, l, sig, k) AS step
      FROM (SELECT *, unnest(range(CAST(rows - list_sum(floors) AS BIGINT))) AS k FROM {name}_sets) LEFT JOIN {name}_rarest USING (chrom, sig)""")
    view(name, f"""
      WITH RECURSIVE walked AS (
        SELECT chrom, CAST(0 AS BIGINT) AS step, '' AS sig, CAST(-1 AS BIGINT) AS fold, room, lacks FROM {name}_room JOIN {name}_lacks USING (chrom)
        UNION ALL
        SELECT chrom, step, sig, fold, list_transform(room, lambda r, i: r - CAST(i = fold + 1 AS BIGINT)),
               list_transform(lacks, lambda x, i: x - CASE WHEN (i - 1) // {n} = fold AND bits[(i - 1) % {n} + 1] = 1 THEN size ELSE 0 END)
        FROM (SELECT w.chrom, r.step, r.sig, r.bits, r.size, w.room, w.lacks,
                     list_sort(list_transform([{each}], lambda f: [CASE WHEN w.room[f + 1] > 0 THEN 0 ELSE 1 END, -coalesce(w.lacks[f * {n} + r.l + 1], 0), -w.room[f + 1], f]))[1][4] AS fold
              FROM walked w JOIN {name}_rest r ON r.chrom = w.chrom AND r.step = w.step + 1))
      SELECT s.chrom, s.sig, list_transform(any_value(s.floors), lambda t, i: t + len(list_filter(list(w.fold), lambda f: f = i - 1))) AS take
      FROM {name}_sets s LEFT JOIN walked w ON w.chrom = s.chrom AND w.sig = s.sig AND w.step > 0 GROUP BY s.chrom, s.sig""")


view("ranked_vectors", f"""
  SELECT row_id, chrom, sig, row_number() OVER (PARTITION BY chrom, sig ORDER BY md5('42:' || row_id), row_id) AS rank
  FROM (SELECT row_id, chrom, {" || '|' || ".join(FEATURES)} AS sig FROM labeled_vectors)""")
_N = 300
view("quota_table", f"""
  SELECT chrom, size, quota + CAST(row_number() OVER (ORDER BY size DESC, chrom) <= {_N} - sum(quota) OVER () AS BIGINT) AS quota
  FROM (SELECT chrom, size, CAST({_N} * size // sum(size) OVER () AS BIGINT) AS quota FROM (SELECT chrom, count(*) AS size FROM labeled_vectors GROUP BY chrom))""")
_FIFTH = "CAST(round(size * 0.2::DOUBLE) AS BIGINT)"
_dealt("thirds", f"[{_FIFTH}, {_FIFTH}, size - 2 * {_FIFTH}]", 3)
_dealt("halves", "[least(quota, size), size - least(quota, size)]", 2)


@query("""
  SELECT row_id, chrom, CASE WHEN rank <= take[1] THEN 'test' WHEN rank <= take[1] + take[2] THEN 'val' ELSE 'train' END AS split
  FROM ranked_vectors JOIN thirds USING (chrom, sig)""")
def stratified_split(spark, sf):
    return sampling.stratified_split(labeled_vectors(spark, sf), FEATURES, ["row_id"]).select("row_id", "chrom", "split")


@query("SELECT variant_key, chrom, CASE chrom WHEN 6 THEN 'test' WHEN 7 THEN 'val' ELSE 'train' END AS split FROM variants")
def chromosome_split(spark, sf):
    return sampling.chromosome_split(variants(spark, sf).select("variant_key", "chrom"))


@query("SELECT chrom, size, quota FROM quota_table")
def chromosome_quotas(spark, sf):
    return sampling.quotas(labeled_vectors(spark, sf), _N)


view("subsample", "SELECT row_id, chrom FROM ranked_vectors JOIN halves USING (chrom, sig) WHERE rank <= take[1]")


def _subsample(spark, sf):
    rows = labeled_vectors(spark, sf)
    return sampling.stratified_subsample(rows, sampling.quotas(rows, _N), FEATURES, ["row_id"])


@query("SELECT row_id, chrom FROM subsample")
def stratified_subsample(spark, sf):
    return _subsample(spark, sf).select("row_id", "chrom")


@query("""
  SELECT feature, round(avg(y), 6) AS "full", round(avg(y) FILTER (s.row_id IS NOT NULL), 6) AS subsample, round(avg(y) FILTER (s.row_id IS NOT NULL) - avg(y), 6) + 0.0 AS delta,
         CAST(sum(y) FILTER (s.row_id IS NOT NULL) AS BIGINT) AS subsample_ones, count(*) FILTER (s.row_id IS NOT NULL AND y = 0) AS subsample_zeros
  FROM labels_long l LEFT JOIN subsample s USING (row_id) GROUP BY feature""")
def subsample_report(spark, sf):
    report = labels.label_vector_report(labeled_vectors(spark, sf), _subsample(spark, sf), FEATURES)
    return report.withColumns({c: r6(F.col(c)) for c in ("full", "subsample", "delta")})


@query("SELECT variant_key, chrom FROM variants ORDER BY md5('7:' || variant_key), variant_key LIMIT 700")
def exact_sample(spark, sf):
    return sample_exact(variants(spark, sf).select("variant_key", "chrom"), 700, 7, ["variant_key"])


@query("SELECT variant_key, chrom FROM event_rank WHERE rank <= chrom * 20")
def sample_by_quota(spark, sf):
    source = variants(spark, sf).select("variant_key", "chrom")
    quotas = source.select("chrom").distinct().withColumn("cnt", (F.col("chrom") * 20).cast("long"))
    return sample_per_chromosome(source, quotas, 42, ["variant_key"])


@query("""
  SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS rank FROM labeled_documents) WHERE rank <= 10""")
def first_n_per_dataset(spark, sf):
    return sampling.first_n_per_group(labeled_documents(spark, sf), 10, ["doc_id"], group=["source"]).select("doc_id", "source")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS place FROM documents")
def shuffled_order(spark, sf):
    return hash_rank(table(spark, sf, "documents").select("doc_id"), 42, ["doc_id"], name="place")


@query("""
  SELECT dataset, key FROM (SELECT 'parts' AS dataset, p_partkey AS key FROM part UNION ALL SELECT 'customers', c_custkey FROM customer)
  QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY md5('42:' || key), key) <= 120""")
def concatenated_datasets(spark, sf):
    sets = {
        "parts": table(spark, sf, "part").select(F.col("p_partkey").alias("key")), "customers": table(spark, sf, "customer").select(F.col("c_custkey").alias("key")),
    }
    return sampling.concat_datasets(sets, ["key"], 120, shuffle=True).select("dataset", "key")
