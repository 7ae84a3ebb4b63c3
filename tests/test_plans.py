"""What the physical plans must and must not hold."""

import contextlib
import io
import re

import pytest

from __spark_entry__ import queries

QUERIES = queries()


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filter_and_columns_reach_the_scan(spark, sf):
    text = plan(QUERIES["above_threshold"](spark, sf))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(value,100.0\)", text)
    schema = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert "props" not in schema and "event_type" not in schema


@pytest.mark.parametrize("name", [
    "merge_intervals", "coverage", "variants_outside_genes", "nearest_feature_distances", "matched_negatives", "region_signal",
    "multi_intersect", "call_broad_peaks", "majority_labels", "merged_samples", "labeled_training_samples",
])
def test_no_pairwise_interval_join(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text
    # What is left of nested-loop joins meets one-row frames only; none of these has any.
    assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["effect_scores", "variant_windows", "kmerized", "coverage", "score_variants_with_kmers", "encoded_tokens"])
def test_no_python_in_the_hot_path(spark, sf, name):
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas", plan(QUERIES[name](spark, sf)))


@pytest.mark.parametrize("name", ["score_variants_with_kmers", "encoded_tokens"])
def test_rows_are_scored_and_encoded_by_themselves(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    if name == "encoded_tokens":
        assert "Exchange" not in text and "Generate" not in text
    else:  # the windows meet their chunks; after that nothing is shuffled, and only features become rows
        assert "HashAggregate" not in text and text.count("Generate (") <= 3


def test_bins_are_cut_without_a_shuffle(spark, tmp_path):
    from varloom.operators import genome

    genome.chunk_sequences(spark.createDataFrame([(1, "ACGT" * 500)], "chrom int, seq string"), 256, 64).write.parquet(str(tmp_path / "genome"))
    chunks = spark.read.parquet(str(tmp_path / "genome"))
    assert "Exchange" not in plan(genome.bin_genome(chunks, 20, forward=5, backward=5, size=256, overlap=64))


@pytest.mark.parametrize("name", [
    "track_lengths", "runs_in_region", "cutoff_grid", "multi_intersect", "nearest_intervals", "nearest_feature_distances", "start_distances",
])
def test_no_frame_is_read_again_for_every_row(spark, sf, name):
    # Spark evaluates a frame that ends at the last row anew for every row: a bucket of n rows would cost n * n / 2.
    assert "unboundedfollowing" not in plan(QUERIES[name](spark, sf)).lower()


def stored_frames(monkeypatch, store):
    """Frames on their way to being stored; ``store`` is what is done with them."""
    from varloom import session
    from varloom.operators import intervals, scale, tracks
    from varloom.plans import inputs

    seen, original = [], session.cut_lineage
    for module in (intervals, scale, tracks, inputs):
        monkeypatch.setattr(module, "cut_lineage", lambda df: seen.append(df) or (original(df) if store else df))
    return seen


@pytest.mark.parametrize("name", [
    "binned_track", "call_broad_peaks", "cutoff_grid", "track_lengths", "cutoff_analysis", "base_values", "call_peaks",
])
def test_no_frame_behind_a_stored_one_is_read_again_either(spark, sf, monkeypatch, name):
    assert stored_frames(monkeypatch, store=False) == []
    text = plan(QUERIES[name](spark, sf)).lower()
    assert "unboundedpreceding" in text and "unboundedfollowing" not in text


@pytest.mark.parametrize("name", ["binned_track", "smoothed_track", "call_broad_peaks"])
def test_runs_are_scanned_once(spark, sf, monkeypatch, name):
    seen = stored_frames(monkeypatch, store=True)
    frames = [QUERIES[name](spark, sf), *seen]
    text = "".join(df._jdf.queryExecution().analyzed().toString() for df in frames)
    assert len(re.findall(r"Window \[.* AS _in__next#", text)) == 1


@pytest.mark.parametrize("name", ["region_signal", "region_deviation"])
def test_blocks_of_regions_are_not_shuffled(spark, sf, name):
    # The list of every region's blocks is several times the regions; it is added up before anything is shuffled.
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables: only what the code asks for is broadcast
    try:
        text = plan(QUERIES[name](spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    joins = re.findall(r"\(\d+\) (\w+)\n(?:Input.*\n)*Left keys \[\d+\]: \[chrom#\w+, level#\w+, block#\w+\]", text)
    assert joins and set(joins) == {"BroadcastHashJoin"}


def test_top_k_is_not_a_full_sort(spark, sf):
    assert "TakeOrderedAndProject" in plan(QUERIES["top_variants"](spark, sf))


def test_a_token_has_one_digest(spark, sf):
    analysed = QUERIES["masked_tokens"](spark, sf)._jdf.queryExecution().analyzed().toString()
    assert analysed.count("md5(") == 1


def test_lines_are_cut_from_bytes(spark, sf):
    from varloom.plans import queries_sequences
    from pyspark.sql import functions as F

    seen = []
    original = queries_sequences.fasta_pieces
    queries_sequences.fasta_pieces = lambda lines: seen.append(lines) or original(lines)
    try:
        QUERIES["genome_from_fasta"](spark, sf)
    finally:
        queries_sequences.fasta_pieces = original
    analysed = seen[0]._jdf.queryExecution().analyzed().toString()
    assert "cast(seq" in analysed and "substring(seq" not in analysed
    assert seen[0].filter(F.length("value") > 60).filter("not value like '>%'").isEmpty()
