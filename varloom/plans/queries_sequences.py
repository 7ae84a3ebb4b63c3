"""Queries on the chunked genome, windows, bins, k-mers and tokens."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from varloom.functions.sequence import MAX_TOKENS, complement, kmer_combinations, kmerize, n_percent
from varloom.operators import evaluate, genome, kmer_track, scoring, tokens
from varloom.plans.inputs import genome_variants, r6, sequences, stored_sequences, table
from varloom.plans.registry import query, view
from varloom.session import cut_lineage
from varloom.sources.readers import fasta_pieces

_SIZE, _OVERLAP, _LENGTH = 4096, 512, 101


def chunks(spark, sf, dna=None):
    return genome.chunk_sequences(dna or stored_sequences(spark, sf), _SIZE, _OVERLAP)


@query(f"""
  SELECT d.chrom, length(seq) AS length, s // {_SIZE} AS chunk_id, s AS chunk_start, md5(substr(seq, s + 1, {_SIZE + _OVERLAP})) AS seq_md5
  FROM dna d, LATERAL (SELECT unnest(range(0, length(d.seq), {_SIZE})) AS s) u""")
def genome_chunks(spark, sf):
    return chunks(spark, sf).select("chrom", "length", "chunk_id", "chunk_start", F.md5("seq").alias("seq_md5"))


@query(f"""
  SELECT d.chrom, length(seq) AS length, s // 1000 AS chunk_id, s AS chunk_start, md5(substr(seq, s + 1, 1100)) AS seq_md5
  FROM dna d, LATERAL (SELECT unnest(range(0, length(d.seq), 1000)) AS s) u""")
def genome_from_fasta(spark, sf):
    """FASTA lines of 60 bases, put back together as chunks."""
    places = F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / 60).cast("int"))
    # Bound once as bytes: a substring of a string walks to its offset, one of bytes does not.
    line = F.transform(F.array(F.col("seq").cast("binary")), lambda b: F.transform(places, lambda i: F.substring(b, i * 60 + 1, F.lit(60)).cast("string")))[0]
    header = F.array(F.concat(F.lit(">"), F.col("chrom").cast("string"), F.lit(" made from a document")))
    lines = stored_sequences(spark, sf).filter(F.length("seq") > 0).select("chrom", F.posexplode(F.concat(header, line)).alias("at", "value"))
    # Eight splits per file, so records run over split borders.
    split = F.floor(F.col("at") / 16)
    source = lines.select("value", F.col("chrom").cast("string").alias("file"), split.alias("split"), "at")
    pieces = fasta_pieces(source).select(F.col("accession").cast("long").alias("chrom"), "offset", "seq")
    return genome.chunk_pieces(pieces, 1000, 100).select("chrom", "length", "chunk_id", "chunk_start", F.md5("seq").alias("seq_md5"))


# --- windows -----------------------------------------------------------------------------------

_HALF = _LENGTH // 2
view("windows", f"""
  SELECT v.variant_key, v.chrom, v.pos, v.pos - 1 - {_HALF} AS start, v.pos - 1 - {_HALF} + {_LENGTH} AS "end",
         substr(seq, v.pos - {_HALF}, {_LENGTH}) AS ref_seq, substr(seq, v.pos - {_HALF}, {_HALF}) || alt || substr(seq, v.pos + 1, {_HALF}) AS alt_seq, alt
  FROM genome_variants v JOIN dna d ON d.chrom = v.chrom WHERE v.pos - 1 - {_HALF} >= 0 AND v.pos - 1 - {_HALF} + {_LENGTH} <= length(seq)""")


def windows(spark, sf):
    dna = stored_sequences(spark, sf)
    snps = cut_lineage(genome_variants(spark, sf, dna))
    return genome.extract_windows(snps, chunks(spark, sf, dna), _LENGTH, _SIZE, _OVERLAP, on_error="split")


@query(f"""
  SELECT variant_key, chrom, pos, start, "end", ref_seq, alt_seq, substr(ref_seq, {_HALF + 1}, 1) AS ref_base, alt AS alt_base,
         {_HALF} AS left_cnt, {_LENGTH - _HALF - 1} AS right_cnt FROM windows""")
def variant_windows(spark, sf):
    good, _ = windows(spark, sf)
    return good.select("variant_key", "chrom", "pos", "start", "end", "ref_seq", "alt_seq", "ref_base", "alt_base", "left_cnt", "right_cnt")


@query(f"""
  SELECT variant_key, v.chrom, pos FROM genome_variants v JOIN dna d ON d.chrom = v.chrom WHERE pos - 1 - {_HALF} < 0 OR pos - 1 - {_HALF} + {_LENGTH} > length(seq)""")
def windows_out_of_bounds(spark, sf):
    return windows(spark, sf)[1].select("variant_key", "chrom", "pos")


# Chunks much shorter than a window, so that every window is put together from four or five of them.
_SHORT, _LONG = 100, 401


@query(f"""
  SELECT variant_key, chrom, pos, pos - 1 - {_LONG // 2} AS start, pos - 1 - {_LONG // 2} + {_LONG} AS "end", md5(substr(seq, pos - {_LONG // 2}, {_LONG})) AS ref_md5,
         md5(substr(seq, pos - {_LONG // 2}, {_LONG // 2}) || alt || substr(seq, pos + 1, {_LONG // 2})) AS alt_md5
  FROM genome_variants JOIN dna USING (chrom) WHERE pos - 1 - {_LONG // 2} >= 0 AND pos - 1 - {_LONG // 2} + {_LONG} <= length(seq)""")
def windows_over_chunks(spark, sf):
    """Windows four times as long as a chunk."""
    dna = stored_sequences(spark, sf)
    snps = cut_lineage(genome_variants(spark, sf, dna))
    good, _ = genome.extract_windows(snps, genome.chunk_sequences(dna, _SHORT, 20), _LONG, _SHORT, 20, on_error="split")
    return good.select("variant_key", "chrom", "pos", "start", "end", F.md5("ref_seq").alias("ref_md5"), F.md5("alt_seq").alias("alt_md5"))


@query("""
  SELECT chrom, s // 250 + 1 AS bin_id, s AS start, least(s + 250, length(seq)) AS "end",
         md5(rpad(repeat('N', greatest(120 - s, 0)::INTEGER) || substr(seq, greatest(s - 120, 0) + 1, least(s + 430, length(seq)) - greatest(s - 120, 0)), 550, 'N')) AS seq_md5
  FROM dna d, LATERAL (SELECT unnest(range(0, length(d.seq), 250)) AS s) u""")
def bins_over_chunks(spark, sf):
    """Bins with extensions, together five times as long as a chunk."""
    short = genome.chunk_sequences(stored_sequences(spark, sf), _SHORT, 20)
    bins = genome.bin_genome(short, 250, forward=180, backward=120, size=_SHORT, overlap=20)
    return bins.select("chrom", "bin_id", "start", "end", F.md5("seq").alias("seq_md5"))


# --- bins --------------------------------------------------------------------------------------

_BIN = 200


@query(f"""
  SELECT chrom, s // {_BIN} + 1 AS bin_id, s AS start, least(s + {_BIN}, length(seq)) AS "end", md5(rpad(substr(seq, s + 1, {_BIN}), {_BIN}, 'N')) AS seq_md5
  FROM dna d, LATERAL (SELECT unnest(range(0, length(d.seq), {_BIN})) AS s) u""")
def genome_bins(spark, sf):
    b = genome.bin_genome(chunks(spark, sf), _BIN, size=_SIZE, overlap=_OVERLAP)
    return b.select("chrom", "bin_id", "start", "end", F.md5("seq").alias("seq_md5"))


view("extended_bins", f"""
  SELECT chrom, s AS start, least(s + {_BIN}, length(seq)) AS "end",
         repeat('N', greatest(30 - s, 0)) || rpad(substr(seq, greatest(s - 30, 0) + 1, s + {_BIN} + 50 - greatest(s - 30, 0)), CAST(s + {_BIN} + 50 - greatest(s - 30, 0) AS INTEGER), 'N') AS seq
  FROM dna d, LATERAL (SELECT unnest(range(0, length(d.seq), 100)) AS s) u""")


def _extended(spark, sf):
    return genome.bin_genome(chunks(spark, sf), _BIN, stride=100, forward=50, backward=30, size=_SIZE, overlap=_OVERLAP)


@query('SELECT chrom, start, "end", seq FROM extended_bins')
def extended_sliding_bins(spark, sf):
    return _extended(spark, sf).select("chrom", "start", "end", "seq")


@query("""SELECT chrom, start FROM extended_bins WHERE 100.0 * (length(seq) - length(replace(seq, 'N', ''))) / length(seq) <= 15""")
def unambiguous_bins(spark, sf):
    return genome.filter_ambiguous(_extended(spark, sf), 15.0).select("chrom", "start")


@query("""
  SELECT chrom, count(*) AS before, count(*) FILTER (100.0 * (length(seq) - length(replace(seq, 'N', ''))) / length(seq) <= 15) AS after FROM extended_bins GROUP BY chrom""")
def ambiguity_stats(spark, sf):
    return genome.ambiguity_stats(_extended(spark, sf), 15.0)


@query("SELECT chrom, round(CASE WHEN length(seq) = 0 THEN 0 ELSE 100.0 * (length(seq) - length(replace(seq, 'N', ''))) / length(seq) END, 6) AS n_percent FROM dna")
def sequence_n_percent(spark, sf):
    return sequences(spark, sf).select("chrom", r6(n_percent(F.col("seq"))).alias("n_percent"))


@query("""
  SELECT chrom, false AS is_complement, md5(seq) AS seq_md5 FROM dna UNION ALL SELECT chrom, true, md5(translate(seq, 'ACGTN', 'TGCAN')) FROM dna""")
def with_complements(spark, sf):
    return genome.add_complements(sequences(spark, sf)).select("chrom", "is_complement", F.md5("seq").alias("seq_md5"))


@query("SELECT chrom, md5(reverse(translate(seq, 'ACGTN', 'TGCAN'))) AS seq_md5 FROM dna")
def reverse_complements(spark, sf):
    return sequences(spark, sf).select("chrom", F.md5(complement(F.col("seq"), reverse=True)).alias("seq_md5"))


@query("""
  SELECT chrom, b.alt, ref, count(*) AS n, CAST(sum(p) AS BIGINT) AS position_sum
  FROM (SELECT chrom, unnest(string_split(seq, '')) AS ref, unnest(range(1, length(seq) + 1)) AS p FROM dna WHERE length(seq) > 0), (VALUES ('A'), ('C'), ('G'), ('T')) b(alt) GROUP BY ALL""")
def saturation_counts(spark, sf):
    """Every position of every sequence with all four bases, counted by reference and alternate."""
    dna = stored_sequences(spark, sf)
    whole = dna.filter(F.length("seq") > 0).select("chrom", F.lit(1).alias("start"), F.length("seq").alias("end"))
    s = genome.saturate_regions(chunks(spark, sf, dna), whole, _SIZE)
    return s.groupBy("chrom", "alt", "ref").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("position_sum"))


# --- k-mers and tokens ---------------------------------------------------------------------------


def _sql_kmers(k: int, seq: str = "seq", limit: int | None = None) -> str:
    last = f"length({seq}) - {k - 2}"
    last = f"least({last}, {limit + 1})" if limit else last
    return f"list_transform(range(1, greatest({last}, 1)), lambda i: substr({seq}, i, {k}))"


@query(f"SELECT chrom, array_to_string({_sql_kmers(6, limit=512)}, ' ') AS kmers FROM dna")
def kmerized(spark, sf):
    return sequences(spark, sf).select("chrom", kmerize(F.col("seq"), 6).alias("kmers"))


view("letters", "SELECT l, i FROM (VALUES ('A', 0), ('C', 1), ('G', 2), ('T', 3), ('N', 4)) v(l, i)")
view("words", "SELECT a.l || b.l || c.l AS kmer, a.i * 25 + b.i * 5 + c.i + 5 AS id FROM letters a, letters b, letters c")


def vocabulary(spark):
    """Three-letter words over ACGTN with ids from 5 on."""
    at = lambda i: F.instr(F.lit("ACGTN"), F.substring("kmer", i, 1)) - 1
    return kmer_combinations(spark, 3).select(F.col("kmer").alias("token"), (at(1) * 25 + at(2) * 5 + at(3) + 5).cast("int").alias("id"))


@query(f"""
  SELECT w.kmer, coalesce(c.n, 0) AS n FROM words w LEFT JOIN (SELECT kmer, count(*) AS n FROM (SELECT unnest({_sql_kmers(3)}) AS kmer FROM dna) GROUP BY kmer) c USING (kmer)""")
def kmer_counts(spark, sf):
    return tokens.kmer_counts(sequences(spark, sf), kmer_combinations(spark, 3), 3)


view("token_rows", f"""
  SELECT chrom, list_transform({_sql_kmers(3, limit=MAX_TOKENS - 2)}, lambda w: instr('ACGTN', substr(w, 1, 1)) * 25 + instr('ACGTN', substr(w, 2, 1)) * 5 + instr('ACGTN', substr(w, 3, 1)) - 31 + 5) AS ids FROM dna""")
view("framed", """SELECT chrom, list_concat([2], list_concat(ids, [3])) AS ids FROM token_rows""")


_IDS = tokens.kmer_ids("ACGTN", 3, 5)


def _encoded(spark, sf):
    words = stored_sequences(spark, sf).select("chrom", kmerize(F.col("seq"), 3, MAX_TOKENS).alias("seq"))
    return tokens.encode(words, _IDS, "chrom", max_length=MAX_TOKENS, start_id=2, end_id=3)


@query(f"""
  SELECT chrom, array_to_string(list_concat(ids, list_transform(range(0, {MAX_TOKENS} - len(ids)), lambda i: 0)), ' ') AS input_ids,
         array_to_string(list_concat(list_transform(ids, lambda i: 1), list_transform(range(0, {MAX_TOKENS} - len(ids)), lambda i: 0)), ' ') AS attention_mask FROM framed""")
def encoded_tokens(spark, sf):
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return _encoded(spark, sf).select("chrom", joined("input_ids"), joined("attention_mask"))


_PART = "CAST(('0x' || substr(md5('42:' || chrom || ':' || (i - 1)), {}, 8)) AS BIGINT)"


@query(f"""
  WITH padded AS (SELECT chrom, list_concat(ids, list_transform(range(0, {MAX_TOKENS} - len(ids)), lambda i: 0)) AS ids FROM framed),
  cells AS (SELECT chrom, i, ids[i] AS id, {_PART.format(1)} / 4294967296.0::DOUBLE < 0.15::DOUBLE AND ids[i] NOT IN (0, 1, 2, 3, 4) AS picked,
            {_PART.format(9)} / 4294967296.0::DOUBLE AS u, {_PART.format(17)} % 130 AS other FROM padded, range(1, {MAX_TOKENS + 1}) t(i))
  SELECT chrom, string_agg(CASE WHEN picked AND u < 0.8::DOUBLE THEN 4 WHEN picked AND u < 0.9::DOUBLE THEN other ELSE id END, ' ' ORDER BY i) AS masked_ids,
         string_agg(CASE WHEN picked AND u < 0.9::DOUBLE THEN id ELSE -100 END, ' ' ORDER BY i) AS labels FROM cells GROUP BY chrom""")
def masked_tokens(spark, sf):
    m = tokens.mask_tokens(_encoded(spark, sf), "chrom", mask_id=4, vocab_size=130, special_ids=[0, 1, 2, 3, 4])
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return m.select("chrom", joined("masked_ids"), joined("labels"))


@query("""
  SELECT t.chrom, CASE WHEN d.source IN ('src0', 'src1') THEN 'test' WHEN d.source = 'src2' THEN 'val' ELSE 'train' END AS split, len(ids) AS tokens,
         CAST(list_sum(ids) AS BIGINT) AS id_sum FROM token_rows t JOIN documents d ON d.doc_id = t.chrom""")
def split_token_dataset(spark, sf):
    split = F.when(F.col("source").isin("src0", "src1"), "test").when(F.col("source") == "src2", "val").otherwise("train")
    rows = sequences(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("chrom"), split.alias("split")), "chrom")
    data = tokens.kmer_token_dataset(rows, vocabulary(spark), 3, "chrom", MAX_TOKENS - 2)
    total = F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x)
    kept = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    # Empty sequences have no tokens.
    return data.select("chrom", "split", kept.cast("long").alias("tokens"), F.when(kept > 0, total).alias("id_sum"))


@query("""
  SELECT count(*) AS tokens, round(avg(CAST(label = predicted AS INTEGER)), 6) AS accuracy, round(avg(loss), 6) AS loss, round(exp(avg(loss)), 6) AS perplexity
  FROM (SELECT CASE WHEN event_id % 7 = 0 THEN -100 ELSE event_id % 5 END AS label, event_id % 3 AS predicted, value / 100 AS loss FROM events) WHERE label <> -100""")
def masked_token_metrics(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events").select(
        F.when(e % 7 == 0, -100).otherwise(e % 5).alias("label"), (e % 3).alias("predicted"), (F.col("value") / 100).alias("loss")
    )
    m = evaluate.masked_token_metrics(rows)
    return m.select("tokens", *[r6(F.col(c)).alias(c) for c in ("accuracy", "loss", "perplexity")])


# --- scoring -------------------------------------------------------------------------------------

_MODEL = ["open", "closed"]


def kmer_weights(spark, units=(50.0, 80.0)):
    """Weights of the 64 three-letter words over ACGT, from their position in the alphabet; powers of two make their sums exact."""
    at = lambda i: F.instr(F.lit("ACGT"), F.substring("kmer", i, 1)) - 1
    index = at(1) * 16 + at(2) * 4 + at(3)
    return kmer_combinations(spark, 3, ["A", "C", "G", "T"]).select(
        "kmer", ((index % 7 - 3) / units[0]).alias("open"), ((index % 11 - 5) / units[1]).alias("closed")
    )


def score_windows(spark, sf):
    dna = stored_sequences(spark, sf)
    model = kmer_track.KmerModel.of(kmer_weights(spark), _MODEL, 3)
    snps = cut_lineage(genome_variants(spark, sf, dna))
    scored = kmer_track.score_variants(snps, chunks(spark, sf, dna), model, _LENGTH, _SIZE, _OVERLAP)
    return kmer_track.long_probabilities(scored, _MODEL)


view("acgt", "SELECT l, i FROM letters WHERE l <> 'N'")
view("weights", """
  SELECT a.l || b.l || c.l AS kmer, ((a.i * 16 + b.i * 4 + c.i) % 7 - 3) / 50.0::DOUBLE AS open, ((a.i * 16 + b.i * 4 + c.i) % 11 - 5) / 80.0::DOUBLE AS closed FROM acgt a, acgt b, acgt c""")
view("window_logits", f"""
  SELECT variant_key, side, coalesce(sum(open), 0) AS open, coalesce(sum(closed), 0) AS closed FROM (
    SELECT variant_key, 'ref' AS side, unnest({_sql_kmers(3, 'ref_seq')}) AS kmer FROM windows UNION ALL
    SELECT variant_key, 'alt', unnest({_sql_kmers(3, 'alt_seq')}) FROM windows) LEFT JOIN weights USING (kmer) GROUP BY ALL""")
view("window_scores", """
  SELECT r.variant_key, f.feature, 1 / (1 + exp(-CASE f.feature WHEN 'open' THEN r.open ELSE r.closed END)) AS p_ref,
         1 / (1 + exp(-CASE f.feature WHEN 'open' THEN a.open ELSE a.closed END)) AS p_alt
  FROM window_logits r JOIN window_logits a ON a.variant_key = r.variant_key AND r.side = 'ref' AND a.side = 'alt', (VALUES ('open'), ('closed')) f(feature)""")


@query("SELECT variant_key, feature, round(p_ref, 6) AS p_ref, round(p_alt, 6) AS p_alt FROM window_scores")
def score_variants_with_kmers(spark, sf):
    return score_windows(spark, sf).select("variant_key", "feature", r6(F.col("p_ref")).alias("p_ref"), r6(F.col("p_alt")).alias("p_alt"))


def gc_model(batch: list[str]):
    """A stand-in for a user's model: logits from the base composition."""
    nothing = [np.nan] * 3
    counts = np.array([nothing if s is None else [s.count("G") + s.count("C"), s.count("A") - s.count("T"), len(s)] for s in batch], float)
    with np.errstate(invalid="ignore"):  # an empty sequence has no composition
        shares = counts[:, :2] / counts[:, 2:]
    return shares * 4 - [2, 0]


@query("""
  SELECT variant_key, round(1 / (1 + exp(-((length(ref_seq) - length(replace(replace(ref_seq, 'G', ''), 'C', ''))) / length(ref_seq) * 4 - 2))), 6) AS gc,
         round(1 / (1 + exp(-(length(replace(ref_seq, 'T', '')) - length(replace(ref_seq, 'A', ''))) / length(ref_seq) * 4)), 6) AS skew FROM windows""")
def score_with_user_model(spark, sf):
    good, _ = windows(spark, sf)
    scored = scoring.score_sequences(good.select("variant_key", "ref_seq"), gc_model, ["gc", "skew"], "ref_seq")
    return scored.select("variant_key", r6(F.col("gc")).alias("gc"), r6(F.col("skew")).alias("skew"))


def _gc_sql(seq: str) -> str:
    return f"round(1 / (1 + exp(-((length({seq}) - length(replace(replace({seq}, 'G', ''), 'C', ''))) / length({seq}) * 4 - 2))), 6)"


@query(f"SELECT variant_key, {_gc_sql('ref_seq')} AS p_ref, {_gc_sql('alt_seq')} AS p_alt FROM windows")
def score_pairs_with_user_model(spark, sf):
    good, _ = windows(spark, sf)
    pairs = scoring.score_pairs(good, gc_model, ["gc", "skew"]).filter("feature = 'gc'")
    return pairs.select("variant_key", r6(F.col("p_ref")).alias("p_ref"), r6(F.col("p_alt")).alias("p_alt"))
