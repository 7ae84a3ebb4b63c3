"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from varloom.llm import decontaminate, exact_dedup, hmm, language_id, line_dedup, mixing, quality_rules, runs, secret_scan, simhash, token_output, url_filter, whitening
from varloom.llm.common import WORD, crc_of_id, shared_path, stored, table
from varloom.llm.registry import query

URL_RULES = [
    url_filter.parse_rule("allow", "com/"), url_filter.parse_rule("block", "example.com/en/"),
    url_filter.parse_rule("allow", "www.example.com/en/"), url_filter.parse_rule("block", "net/es/"),
    url_filter.parse_rule("block", "net/fr/"),
]


@query()
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item that a document holds: one row per document and distinct item, none for clean documents."""
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN NULL ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut
), rules(verdict, host, path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fitting AS (
  SELECT p.page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host) DESC, length(r.path) DESC) AS place
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fitting f ON p.page_id = f.page_id AND f.place = 1
""")
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


# Longer documents say more: copies are expected in proportion to these, and so are chances.
PREFERENCE = "CASE WHEN {size} < 50 THEN 2.0 WHEN {size} < 500 THEN 3.0 ELSE 4.0 END"


def _rate_steps(steps: int) -> str:
    """The rate of each source after so many steps, each of which leaves out the documents that are full by then."""
    sql = "rate0 AS (SELECT source, source_size, target, CASE WHEN liked > 0 THEN target / liked ELSE 0 END AS rate FROM targets)"
    for i in range(steps):
        sql += f""", rate{i + 1} AS (
  SELECT r.source, any_value(r.source_size) AS source_size, any_value(r.target) AS target,
    CASE WHEN sum(CASE WHEN rate * pref >= 2 THEN 0 ELSE size * pref END) > 0 THEN greatest(any_value(rate), (any_value(r.target) - 2.0::DOUBLE * sum(CASE WHEN rate * pref >= 2 THEN size ELSE 0 END)) /
      sum(CASE WHEN rate * pref >= 2 THEN 0.0::DOUBLE ELSE size * pref END)) ELSE any_value(rate) END AS rate
  FROM rate{i} r JOIN base b ON b.source IS NOT DISTINCT FROM r.source GROUP BY r.source)"""
    return sql


@query(r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    md5('7:' || coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, '')) AS draw FROM documents
), base AS (
  SELECT *, (""" + PREFERENCE.format(size="size") + r""")::DOUBLE AS pref FROM sized
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size * pref) AS liked FROM base GROUP BY source
), placed AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sizes
), room AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS per_weight FROM placed
), filled AS (
  SELECT *, coalesce(sum(source_size) OVER earlier, 0)::DOUBLE AS words_before, coalesce(sum(weight) OVER earlier, 0)::DOUBLE AS weight_before,
    sum(source_size) OVER ()::DOUBLE AS words, sum(weight) OVER ()::DOUBLE AS weights
  FROM room WINDOW earlier AS (ORDER BY per_weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (1.5::DOUBLE * words - 2.0::DOUBLE * words_before) / (weights - weight_before) AS level FROM filled
), chosen AS (
  SELECT coalesce((SELECT level FROM levels WHERE level <= per_weight ORDER BY per_weight, place LIMIT 1), 'inf'::DOUBLE) AS per_weight
), targets AS (
  SELECT l.source, l.source_size, l.liked, least(2.0::DOUBLE * l.source_size, l.weight * c.per_weight) AS target FROM levels l, chosen c
), """ + _rate_steps(3) + r""", expected AS (
  SELECT b.*, r.source_size, r.target, floor(least(2.0::DOUBLE, rate * pref)) AS whole, least(2.0::DOUBLE, rate * pref) - floor(least(2.0::DOUBLE, rate * pref)) AS p,
    (('0x' || substr(draw, 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM base b JOIN rate3 r ON b.source IS NOT DISTINCT FROM r.source
), odds AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) ELSE 'inf'::DOUBLE END AS q, CASE WHEN whole + 1 <= 2 THEN size ELSE 0 END AS open,
    greatest(0, target - sum(whole * size) OVER (PARTITION BY source)) AS need FROM expected
), ranked AS (
  SELECT *, coalesce(sum(open) OVER (PARTITION BY source ORDER BY whole + 1 > 2, q, draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM odds
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN whole + 1 <= 2 AND before + size / 2 <= need THEN 1 ELSE 0 END))::BIGINT AS taken FROM ranked
""")
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document; longer documents are preferred."""
    docs = table(spark, sf_dir, "documents")
    preference = F.expr(PREFERENCE.format(size="size"))
    sized = docs.select("doc_id", "text", "source", mixing.n_words("text").alias("size"))
    return mixing.mix_sizes(sized, preference=preference).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


@query()
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = simhash.assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, size and survivor of every document."""
    return exact_dedup.assign(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("text_digest").alias("text_sha256")
    )


@query()
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, the recurring ones that are dropped, and what is left of its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_recurring_lines(docs, passage_texts=line_dedup.PASSAGE_TEXTS).select(
        "doc_id", "n_lines", "dropped_lines", F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256")
    )


def token_checksums(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Encode ``docs`` in a new folder of the shared one and sum up what its files hold."""
    path = shared_path(spark, "tokens")
    token_output.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.read_checksums(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query()
def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the files."""
    return token_checksums(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op8_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under the unigram and the hidden Markov model; a tenth is held out."""
    return hmm.score_documents(table(spark, sf_dir, "documents"))


@query()
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of every document with the forest's verdict."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a quarter of them is held out of learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_of_id() % 4 == 2)
    model = language_id.fit(docs, learn=~F.col("held_out"))
    return language_id.predict(docs, model).select("doc_id", "held_out", "lang_pred", "score")


def _altered(text: str, doc_id: str) -> Column:
    """The text with words that repeat from some place on, in a tenth of the documents; the others as they are."""
    words = F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"))
    n, hashed = F.size(words), crc_of_id(doc_id)
    g = F.floor(hashed / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    joined = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")
    return F.when((hashed % 10 == 0) & F.col(text).rlike(WORD), joined).otherwise(F.col(text))


@query()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of runs, the longest one, and checksums of all runs and of the collapsed text, of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _altered("text", "doc_id").alias("text"))
    found = runs.find_runs(docs).withColumn("longest", runs.longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length, period = F.col("longest.length"), F.col("longest.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )


@query()
def op12_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every embedding, with the facts of the fit."""
    raw = table(spark, sf_dir, "embeddings").filter(whitening.usable("embedding"))
    entries = F.transform("embedding", lambda c: F.floor(1024 * c.cast("double")) + 100000)
    rows = stored(raw.select("vec_id", entries.alias("x")), "whole-entries")
    model = whitening.fit(rows, "x")
    error = whitening.identity_error(rows, model, "x")
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]).cast("array<double>")
    # n * x - S is exact as a long, its square as a decimal.
    apart = F.zip_with("x", F.array(*[F.lit(s) for s in model.sums]).cast("array<long>"), lambda x, s: (F.lit(model.n) * x - s).cast("decimal(19,0)"))
    squares = F.aggregate(apart, F.lit(0).cast("decimal(38,0)"), lambda total, v: (total + v * v).cast("decimal(38,0)"))
    found = whitening.whiten(rows, model, "x").filter("whitened is not null")
    return found.select("vec_id", squares.cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


@query()
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and whether fixed limits and the learned rules keep it."""
    counted = stored(quality_rules.statistics(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "statistics")
    rules = quality_rules.learn(counted, table(spark, sf_dir, "labels"))
    n = lambda name: F.col("statistics").getField(name)
    failed = (n("n_words") < 50) | (100 * n("n_repeat_words") > 50 * n("n_words"))
    return counted.select(
        "doc_id", *[n(name).alias(name) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"), (~failed & quality_rules.verdict(rules, quality_rules.features())).alias("kept"),
    )
