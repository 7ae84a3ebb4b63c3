"""K-mer counts, token encoding and masking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from varloom.functions.sequence import MAX_TOKENS, kmerize, kmers
from varloom.operators.scale import hash_order

# The label of tokens that carry no loss, the masked share and its division.
NO_LABEL = -100
MASK_SHARE = 0.15
MASK_DIVISION = (0.8, 0.1, 0.1)


def kmer_counts(df: DataFrame, vocabulary: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Count of every word of the vocabulary over all sequences, zero where it never occurs."""
    counts = df.select(F.explode(kmers(F.col(seq), k)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.join(counts, "kmer", "left").select("kmer", F.coalesce("n", F.lit(0)).alias("n"))


def kmer_ids(alphabet: str, k: int, first_id: int) -> Callable[[Column], Column]:
    """The id of a word when the vocabulary is all words of ``k`` letters in order: the word read as a number; null for other words."""
    size = len(alphabet)

    def of(word: Column) -> Column:
        digits = [F.position(F.substring(word, i + 1, 1), F.lit(alphabet)) - 1 for i in range(k)]
        number = sum((d * size ** (k - 1 - i) for i, d in enumerate(digits)), F.lit(first_id))
        return F.when((F.length(word) == k) & (F.least(*digits) >= 0 if k > 1 else digits[0] >= 0), number.cast("int"))

    return of


def encode(
    df: DataFrame, vocabulary: DataFrame | Callable[[Column], Column], key: str, seq: str = "seq", max_length: int = MAX_TOKENS,
    pad_id: int = 0, unknown_id: int = 1, start_id: int | None = None, end_id: int | None = None,
) -> DataFrame:
    """Token ids and attention mask of space-separated words, cut and padded to ``max_length``.

    ``vocabulary`` is a function from word to id, such as ``kmer_ids``, and then every row is encoded by itself; or a frame
    (token, id) of any words, which is joined. The words of one row come together again in the same map task, so
    only finished arrays are shuffled.
    """
    specials = sum(i is not None for i in (start_id, end_id))
    words = F.slice(F.split(F.col(seq), " "), 1, max_length - specials)
    if callable(vocabulary):
        known = F.transform(F.filter(words, lambda w: F.length(w) > 0), lambda w: F.coalesce(vocabulary(w), F.lit(unknown_id)))
        ids = df.select(key, F.coalesce(known, F.array().cast("array<int>")).alias("_body"))
    else:
        placed = df.select(key, F.posexplode_outer(words).alias("at", "token")).join(vocabulary, "token", "left")
        ids = placed.groupBy(key).agg(F.collect_list(
            F.when(F.length("token") > 0, F.struct("at", F.coalesce("id", F.lit(unknown_id)).cast("int").alias("id")))
        ).alias("_pairs")).select(key, F.transform(F.array_sort("_pairs"), lambda p: p["id"]).alias("_body"))
    framed = F.concat(
        F.array(*([F.lit(start_id)] if start_id is not None else [])).cast("array<int>"), F.col("_body"),
        F.array(*([F.lit(end_id)] if end_id is not None else [])).cast("array<int>"),
    )
    padding = lambda value: F.array_repeat(F.lit(value), F.lit(max_length) - F.size("_ids"))
    return ids.withColumn("_ids", framed).select(
        key, F.concat("_ids", padding(pad_id)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("_ids")), padding(0)).alias("attention_mask"),
    )


def mask_tokens(
    df: DataFrame, key: str, mask_id: int, vocab_size: int, special_ids: Sequence[int], seed: int = 42,
    share: float = MASK_SHARE, division: tuple[float, float, float] = MASK_DIVISION, ids: str = "input_ids",
) -> DataFrame:
    """Masked ids and labels. Of the picked tokens a part becomes the mask, a part a random id, the rest stay.

    Picks come from the md5 of seed, key and position; tokens that stay unchanged carry no label.
    """
    special = F.array(*[F.lit(i) for i in special_ids]).cast("array<int>")
    digest = lambda i: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string")))
    part = lambda h, at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    unit = lambda h, at: part(h, at) / float(1 << 32)

    def pick(cell):
        picked = (unit(cell["h"], 1) < share) & ~F.array_contains(special, cell["id"])
        return F.struct(cell["id"].alias("id"), cell["h"].alias("h"), picked.alias("picked"))

    def decide(cell):
        token, h, picked = cell["id"], cell["h"], cell["picked"]
        masked, replaced = unit(h, 9) < division[0], unit(h, 9) < division[0] + division[1]
        new = F.when(picked & masked, F.lit(mask_id)).when(picked & replaced, (part(h, 17) % vocab_size).cast("int")).otherwise(token)
        return F.struct(new.alias("id"), F.when(picked & replaced, token).otherwise(F.lit(NO_LABEL)).alias("label"))

    # One after the other, as a digest inside a lambda function is made again for each place that names it.
    cells = F.transform(ids, lambda token, i: F.struct(token.alias("id"), digest(i).alias("h")))
    decided = df.withColumn("_d", F.transform(F.transform(cells, pick), decide))
    return decided.select(key, F.transform("_d", lambda d: d["id"]).alias("masked_ids"), F.transform("_d", lambda d: d["label"]).alias("labels"))


def kmer_token_dataset(
    df: DataFrame, vocabulary: DataFrame | Callable[[Column], Column], k: int, key: str, max_length: int = MAX_TOKENS, seq: str = "seq", split: str = "split",
) -> DataFrame:
    """K-mers, then token ids, for the rows of every split in one job."""
    words = df.withColumn(seq, kmerize(F.col(seq), k, max_length))
    return df.select(key, split).join(encode(words, vocabulary, key, seq, max_length), key)
