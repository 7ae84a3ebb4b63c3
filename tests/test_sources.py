"""Files in, files out."""

import json

import pytest
from pyspark.sql import functions as F

from varloom.operators import sampling, stats
from varloom.sources import catalog, readers, writers
from varloom.streaming import scoring as streaming


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def lines_of(path):
    return [line for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]


@pytest.mark.parametrize("split_bytes", [64, 1 << 20])
def test_fasta_over_file_splits(spark, tmp_path, split_bytes):
    import random

    rng = random.Random(5)
    records = {"AP014957.1": 700, "skip": 90, "AP014958.1": 61, "AP014968.1": 300}
    bases = {name: "".join(rng.choice("acgtn") for _ in range(n)) for name, n in records.items()}
    text = "".join(f">{name} some words\n" + "".join(seq[i:i + 60] + "\n" for i in range(0, len(seq), 60)) for name, seq in bases.items())
    path = put(tmp_path, "g.fa", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    try:
        chunks = readers.read_fasta(spark, path, [a for a in records if a != "skip"], size=100, overlap=30).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for number, name in ((1, "AP014957.1"), (2, "AP014958.1"), (12, "AP014968.1")):
        whole = bases[name].upper()
        own = sorted((c["chunk_start"], c["seq"], c["length"]) for c in chunks if c["chrom"] == number)
        assert own == [(s, whole[s:s + 130], len(whole)) for s in range(0, len(whole), 100)]


def test_variant_files(spark, tmp_path):
    vcf = put(tmp_path, "a.vcf", "##h\n#CHROM\tPOS\tID\tREF\tALT\nAP014957.1\t7\trs1\tA\tG\tx\n")
    assert tuple(readers.vcf_to_snp_list(readers.read_vcf(spark, vcf), keep_id=True).collect()[0]) == (1, 7, "rs1", "A", "G")
    assert readers.vcf_to_snp_list(readers.read_vcf(spark, vcf), numbered=False).collect()[0]["chrom"] == "Chr1"
    pvar = put(tmp_path, "a.pvar", "#c\n1\t5\t.\tA\tG\t.\tPASS\tAF=0.1\n")
    row = readers.read_pvar(spark, pvar).collect()[0]
    assert (row["POS"], row["ID"], row["FILTER"]) == (5, None, "PASS")
    assert readers.read_bim(spark, put(tmp_path, "a.bim", "1\trs1\t0.5\t77\tA\tG\n")).collect()[0]["BP"] == 77
    gff = put(tmp_path, "a.gff", "#x\nchr01\ts\tgene\t3\t9\t.\t+\t.\tID=g1;N=2\n")
    assert readers.read_gff(spark, gff).collect()[0]["end"] == 9
    several = readers.read_vcf(spark, put(tmp_path, "b.vcf", "AP014957.1\t7\trs1\tA\tG,T\n"))
    for asked in (several.select("CHROM", "POS"), several.agg(F.count(F.lit(1)))):
        with pytest.raises(Exception, match="more than one alternate at AP014957.1:7"):
            asked.collect()
    lost = readers.read_freq(spark, put(tmp_path, "b.frq", "CHROM\tPOS\tN\n1\t1e5\t2\t20\tA:0.9\n"))
    assert lost.collect()[0]["POS"] == 100_000
    with pytest.raises(Exception, match="no position"):
        readers.read_freq(spark, put(tmp_path, "c.frq", "CHROM\tPOS\tN\n1\tx\t2\t20\tA:0.9\n")).collect()
    freq = put(tmp_path, "a.frq", "CHROM\tPOS\tN_ALLELES\tN_CHR\t{ALLELE:FREQ}\n1\t5\t2\t20\tA:0.9\tG:0.1\n1\t6\t3\t20\tA:0.5\tG:0.3\tT:0.2\n")
    assert [r["freqs"] for r in readers.read_freq(spark, freq).orderBy("POS").collect()] == [[0.9, 0.1], [0.5, 0.3, 0.2]]
    snps = put(tmp_path, "s.tsv", "chrom\tpos\tid\tref\talt\n1\t5\tx\tA\tG\n")
    assert tuple(readers.read_snp_list(spark, snps).collect()[0]) == (1, 5, "x", "A", "G")


def test_interval_files(spark, tmp_path):
    put(tmp_path, "bed/H3K9ac_rep1.bed", "chr1\t0\t5\n")
    assert readers.read_bed(spark, str(tmp_path / "bed"), True).collect()[0]["feature"] == "H3K9ac"
    put(tmp_path, "bdg/s1.bdg", "chr1\t0\t5\t1.5\n")
    row = readers.read_bedgraph(spark, str(tmp_path / "bdg")).collect()[0]
    assert (row["value"], row["sample"]) == (1.5, "s1")
    put(tmp_path, "closest/a/vs_H3K4me3.tsv", "c\t0\t1\tc\t5\t6\t5\n")
    assert readers.read_closest(spark, str(tmp_path / "closest")).collect()[0]["feature"] == "H3K4me3"
    head = "chrom\tstart\tend\tnum_overlaps\tbases_covered\tinterval_length\tfraction_covered\tpercent_covered\n"
    put(tmp_path, "cov/s1.tsv", head + "c\t0\t10\t1\t5\t10\t0.5\t50.0\n")
    assert tuple(readers.read_coverage(spark, str(tmp_path / "cov")).collect()[0]) == ("c", 0, 10, 50.0, "s1")


def test_small_tables(spark, tmp_path):
    features = readers.read_features(spark, put(tmp_path, "features.csv", "features\nb\na\n"))
    assert readers.feature_list(features) == ["b", "a"]
    put(tmp_path, "prev/3.csv", "1,0,ratio\n4,6,0.4\n1,9,0.1\n")
    got = readers.read_prevalence(spark, str(tmp_path / "prev"), features)
    assert sorted(map(tuple, got.collect())) == [("a", "Chr3", 1, 9, 0.1), ("b", "Chr3", 4, 6, 0.4)]
    put(tmp_path, "th/ATAC.tsv", "significance_lvl\tscore\n0.05\t1.5\n")
    assert tuple(readers.read_thresholds(spark, str(tmp_path / "th"), True).collect()[0]) == (0.05, 1.5, "ATAC")
    log = put(tmp_path, "log.json", json.dumps([{"step": 1, "loss": 0.5}, {"step": 1, "loss": 0.4}]))
    assert [r["loss"] for r in readers.read_json_log(spark, log).orderBy("ordinal").collect()] == [0.5, 0.4]
    ld = put(tmp_path, "ld.txt", "1.0  0.5\n0.5 1.0\n")
    cells = readers.read_ld_matrix(spark, ld)
    assert {(r["i"], r["j"]): r["r"] for r in cells.collect()} == {(0, 0): 1.0, (0, 1): 0.5, (1, 0): 0.5, (1, 1): 1.0}


def test_datasets(spark, tmp_path):
    df = spark.range(40).select("id", (F.col("id") % 14).cast("int").alias("chr"), F.lit("ACGT").alias("seq"), (F.col("id") % 2).cast("int").alias("f"))
    writers.write_samples(df, str(tmp_path / "samples"))
    read = readers.read_samples(spark, str(tmp_path / "samples"))
    assert sorted({r["chr"] for r in read.select("chr").collect()}) == list(range(1, 13))
    assert list((tmp_path / "samples").glob("chr=1/*.zstd.parquet"))
    split = sampling.chromosome_split(df, chrom="chr")
    writers.write_splits(split, sampling.split_stats(split, "chr"), str(tmp_path / "splits"))
    assert readers.read_labeled(spark, str(tmp_path / "splits/data")).count() == 40
    assert spark.read.csv(str(tmp_path / "splits/stats"), header=True).count() == 14
    first = readers.read_sequence_arrays(spark, str(tmp_path / "splits/data"), 1)
    assert first.select("file").distinct().count() == first.count()
    mixed = readers.read_sequence_arrays(spark, str(tmp_path / "splits/data"), 1, shuffle=True)
    assert mixed.count() == first.count()
    df.write.partitionBy("chr").parquet(str(tmp_path / "keyed"))
    assert readers.read_keyed_annotations(spark, str(tmp_path / "keyed"), 3, "chr").count() == df.filter("chr = 3").count()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 9, "A"), (1, 30, "C"), (1, 4, "G")], "CHR int, POS long, REF string")
    none = F.lit(None).cast("string")
    sites = df.select("CHR", "POS", none.alias("ID"), "REF", F.lit("T").alias("ALT"), none.alias("QUAL"), F.lit("PASS").alias("FILTER"), none.alias("INFO"))
    writers.write_vcf(sites, str(tmp_path / "vcf"))
    written = lines_of(tmp_path / "vcf")
    assert written[0] == "##fileformat=VCFv4.2" and written[1].split("\t")[:2] == ["#CHROM", "POS"]
    assert [line.split("\t")[:5] for line in written[2:]] == [["1", "4", ".", "G", "T"], ["1", "30", ".", "C", "T"], ["2", "9", ".", "A", "T"]]
    writers.write_bed(spark.createDataFrame([(1, 0, 5)], "chrom int, start long, end long"), str(tmp_path / "bed"))
    assert lines_of(tmp_path / "bed") == ["Chr1\t0\t5"]
    writers.write_tsv(df, str(tmp_path / "tsv"), ["POS", "REF"])
    assert "POS\tREF" in lines_of(tmp_path / "tsv")
    writers.write_if_absent(df, str(tmp_path / "once"))
    writers.write_if_absent(df.limit(1), str(tmp_path / "once"))
    assert spark.read.csv(str(tmp_path / "once"), header=True).count() == 3
    writers.write_if_absent(df.limit(1), str(tmp_path / "once"), overwrite=True)
    assert spark.read.csv(str(tmp_path / "once"), header=True).count() == 1
    writers.write_with_metadata(df, str(tmp_path / "run"), stats.run_metadata(3, 2, 0.05, "sidak", input="x"))
    assert spark.read.json(str(tmp_path / "run/metadata")).collect()[0]["M_eff"] == "2"
    writers.write_per_feature(df.withColumnRenamed("REF", "feature"), str(tmp_path / "marks"))
    assert (tmp_path / "marks/feature=A").exists()
    writers.write_best_metrics(df.limit(1), str(tmp_path / "best"))
    assert spark.read.json(str(tmp_path / "best")).count() == 1
    writers.write_kmer_list(spark.range(10).coalesce(1), str(tmp_path / "kmers"), rows_per_file=4)
    assert len(list((tmp_path / "kmers").glob("part-*"))) == 3


def test_keyless_scores_and_best_rows(spark, tmp_path):
    rows = "".join(f"{i}.5\t{-i}.25\n" for i in range(300))
    path = put(tmp_path, "scores.tsv", "f00\tf01\n" + rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = {r["variant_key"]: (r["f00"], r["f01"]) for r in readers.read_keyless_tsv(spark, path, ["f00", "f01"]).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i: (i + 0.5, float(f"{-i}.25")) for i in range(300)}
    for model, loss in (("k3", 0.4), ("k6", 0.3)):
        put(tmp_path, f"best/{model}/best.json", json.dumps({"step": 10, "eval_loss": loss}) + "\n")
    best = readers.read_best_metrics(spark, str(tmp_path / "best"), "step long, eval_loss double")
    assert sorted((r["model"], r["eval_loss"]) for r in best.collect()) == [("k3", 0.4), ("k6", 0.3)]


def test_logits_and_labels(spark, tmp_path):
    rows = range(200)
    logits = put(tmp_path, "logits.txt", "".join(f"{i}.5 -{i}\n" for i in rows))
    labels = put(tmp_path, "labels.txt", "".join(f"{i % 2} 1\n" for i in rows))
    both = readers.read_evaluation(spark, logits, labels)
    writers.write_evaluation(both, str(tmp_path / "evaluation"), "ordinal")
    got = {r["ordinal"]: (r["logits"], r["labels"]) for r in spark.read.parquet(str(tmp_path / "evaluation")).collect()}
    assert got == {i: ([i + 0.5, -i], [i % 2, 1]) for i in rows}
    with pytest.raises(Exception, match="differ at row 199"):
        readers.read_evaluation(spark, logits, put(tmp_path, "short.txt", "0 1\n" * 199)).collect()


def test_catalog_append(spark, tmp_path):
    samples = spark.createDataFrame([("a1", "leaf", "H3K9ac", "x.bw", "http")], "Accession string, Tissue string, Histone_Mod string, File_Name string, Link string")
    path = str(tmp_path / "catalog")
    catalog.add_samples(samples, path, "histone", "S1")
    catalog.add_samples(samples, path, "histone", "S2", notes="n")
    rows = spark.read.parquet(path)
    assert rows.columns == catalog.HISTONE
    assert catalog.sample_paths(catalog.select_samples(rows, Study="S2", Tissue=None)).collect()[0][0] == ".data/S2/histone/leaf/x.bw"


def test_scores_of_arriving_windows(spark, tmp_path):
    """New window files are scored once each and appended."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "variant_key long, seq string"
    model = lambda batch: [[float(len(s))] for s in batch]
    for round_, rows in enumerate(([(1, "AC")], [(2, "ACG"), (3, "")])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        streaming.append_scores(spark, source, schema, out, state, model, ["f"], logits=False)
        assert spark.read.parquet(out).count() == (1, 3)[round_]
    assert {r["variant_key"]: r["f"] for r in spark.read.parquet(out).collect()} == {1: 2.0, 2: 3.0, 3: 0.0}
