"""Exact duplicates by skew-safe combining, in three steps that each compare the full content.

1. Every task merges equal texts of its own split (map-side combine), so a text that a third of all rows share leaves a
   task once per salt.
2. Groups of (digest, salt, text) merge what the tasks sent; the salt spreads one hot text over many tasks.
3. The winners of the salts merge per (digest, text).

The digest only places rows; two texts are equal only if the texts themselves are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from varloom.llm.common import free_name, stored

SALTS = 16


def sha256_of(text: Column) -> Column:
    return F.sha2(text, 256)


def combine_groups(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256_of,
) -> DataFrame:
    """One row per distinct text: digest, text, keep_id (largest id), group_size, and n_texts that share the digest."""
    content = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(
        F.col(doc_id).alias("keep_id"), content.alias("text"), digest(content).alias("digest"),
        F.pmod(F.xxhash64(F.col(doc_id)), F.lit(salts)).cast("int").alias("salt"),
    )
    salted = keyed.groupBy("digest", "salt", "text").agg(
        F.max("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    # Dealt by digest alone: the sum per text and the number of texts per digest need no further shuffle.
    merged = salted.drop("salt").repartition("digest").groupBy("digest", "text").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    return merged.withColumn("n_texts", F.count(F.lit(1)).over(W.partitionBy("digest")))


def assign(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256_of,
) -> DataFrame:
    """All rows and columns of ``docs`` plus keep_id, group_size, kept and text_digest.

    - Of equal texts the row with the largest id stays; its id is the keep_id of all of them.
    - A null text equals the empty one. A null id loses against any other; where all are null, keep_id is null and all
      rows count as kept.
    - Rows that repeat both text and id cannot be told apart: all are marked kept (``deduplicate`` leaves one).
    - Any length of text is compared whole. An empty table gives no rows.
    - Result columns whose names ``docs`` has already get leading underscores.
    """
    found = stored(
        combine_groups(docs, text, doc_id, salts, digest)
        # The text is needed again only where different texts share a digest.
        .withColumn("text", F.when(F.col("n_texts") > 1, F.col("text"))),
        "exact-groups",
    )
    names = {n: free_name(docs.columns, n) for n in ("keep_id", "group_size", "kept", "text_digest")}
    content = F.coalesce(F.col(text), F.lit(""))
    members = docs.withColumn(names["text_digest"], digest(content))

    def joined(groups: DataFrame, same_text: bool) -> DataFrame:
        same = F.col(names["text_digest"]) == F.col("g.digest")
        if same_text:
            same = same & (F.coalesce(F.col(f"m.{text}"), F.lit("")) == F.col("g.text"))
        return members.alias("m").join(groups.alias("g"), same).select(
            "m.*", F.col("g.keep_id").alias(names["keep_id"]), F.col("g.group_size").alias(names["group_size"]),
            F.col(f"m.{doc_id}").eqNullSafe(F.col("g.keep_id")).alias(names["kept"]),
        )

    clashing = found.filter("n_texts > 1")
    result = joined(found.filter("n_texts = 1"), False)
    return result if clashing.isEmpty() else result.unionByName(joined(clashing, True))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The columns of ``docs``, one row per distinct text: that of ``assign`` that is kept, repeats of it taken out."""
    names = {n: free_name(docs.columns, n) for n in ("kept", "text_digest")}
    kept = assign(docs, text, doc_id, **options).filter(F.col(names["kept"]))
    same = free_name(kept.columns, "same_text")
    return kept.withColumn(same, F.coalesce(F.col(text), F.lit(""))).dropDuplicates(
        [names["text_digest"], same]
    ).select(*[F.col(f"`{c}`") for c in docs.columns])
