"""Near duplicates by SimHash and BK-trees.

A fingerprint holds, bit by bit, what over half of a text's shingle hashes hold. Documents whose fingerprints differ in at
most ``radius`` bits are linked, and linked documents form groups.

Distinct fingerprints are dealt into shards. Two of them within the radius agree on at least one of radius + 1 blocks of
bits, so a shard is all fingerprints with the same value of one block, and each fingerprint is in radius + 1 shards. A
shard that holds more than ``shard_rows`` fingerprints is dealt again by blocks of its remaining bits, until it fits
a task. In its shard a fingerprint is looked up in a BK-tree, whose children hang by their integer Hamming distance to
the parent: only edges within the radius of the query's own distance are followed. The shard gives a spanning forest of
its links, never all pairs, and the forests meet in star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from varloom.llm.common import discard, free_name, stored

WORDS = 3
RADIUS = 2
BITS = 64
SHARD_ROWS = 10_000
BROADCAST_ROWS = 2_000_000
_CHUNK = 1 << 15


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Signed 64-bit fingerprint of the whole text; ASCII letters lower-cased, words between ASCII white space.

    Shingles count as often as they occur; a text of fewer words is one shingle, one without words gives 0.
    """
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: ASCII rules only
    if not tokens:
        return 0
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    joined = b" ".join(tokens)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(words, len(tokens))
    firsts, lasts = starts[:len(tokens) - size + 1].tolist(), ends[size - 1:].tolist()
    hashed = xxhash.xxh64_intdigest
    ones, total = np.zeros(BITS, np.int64), len(firsts)
    for at in range(0, total, _CHUNK):
        found = np.array([hashed(joined[a:b], 42) for a, b in zip(firsts[at:at + _CHUNK], lasts[at:at + _CHUNK])], "<u8")
        ones += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, words: int = WORDS) -> Column:
    @F.pandas_udf("long")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return found(text)


class BKTree:
    """Children by integer Hamming distance to their parent."""

    def __init__(self):
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while True:
            distance = (value ^ node[0]).bit_count()
            if distance not in node[1]:
                node[1][distance] = (value, {})
                return
            node = node[1][distance]

    def within(self, value: int, radius: int) -> list[int]:
        found, waiting = [], [self.root] if self.root else []
        while waiting:
            own, children = waiting.pop()
            distance = (value ^ own).bit_count()
            if distance <= radius:
                found.append(own)
            for edge in range(distance - radius, distance + radius + 1):
                child = children.get(edge)
                if child is not None:
                    waiting.append(child)
        return found


def forest(values: Sequence[int], radius: int) -> list[tuple[int, int]]:
    """(value, root) for every value that a chain of links joins to a smaller one, the root."""
    tree, parent = BKTree(), {}

    def top(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for value in values:
        parent[value] = value
        unsigned = value & 0xFFFFFFFFFFFFFFFF
        for other in tree.within(unsigned, radius):
            a, b = top(value), top(other if other < 1 << 63 else other - (1 << 64))
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(unsigned)
    return [(v, top(v)) for v in parent if top(v) != v]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _blocks(free: Sequence[int], pieces: int) -> list[int]:
    """Masks of ``pieces`` blocks of the bit positions ``free``."""
    return [sum(1 << int(b) for b in part) for part in np.array_split(list(free), pieces)]


def shards(distinct: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """(fingerprint, path, value): which blocks a shard fixes and their bits. No shard of more than one row is too large,
    as long as free bits are left to deal it by."""
    masks = dict(enumerate(_blocks(range(BITS), radius + 1)))
    waiting = distinct.select("fingerprint", F.lit(None).cast("int").alias("parent"))
    parents: dict[int | None, list[int]] = {None: list(masks)}
    done = []
    while True:
        # A row takes part in every block of its parent shard.
        options = [
            F.when(
                F.col("parent").eqNullSafe(F.lit(parent)),
                F.array(*[F.struct(F.lit(p).alias("path"), F.col("fingerprint").bitwiseAND(F.lit(_signed(masks[p]))).alias("value")) for p in paths]),
            ) for parent, paths in parents.items()
        ]
        placed = stored(
            waiting.select("fingerprint", F.explode(F.coalesce(*options)).alias("shard")).select("fingerprint", "shard.*"), "shards"
        )
        sizes = stored(placed.groupBy("path", "value").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "shard-sizes")
        counted = placed.join(sizes, ["path", "value"])  # a fingerprint alone in its shard has no link there
        done.append(counted.filter(F.col("rows") <= shard_rows).drop("rows"))
        large = stored(sizes.filter(F.col("rows") > shard_rows), "large-shards")
        paths = [r[0] for r in large.select("path").distinct().collect()]  # (radius + 1) ** depth at most
        parents = {}
        for path in paths:
            free = [b for b in range(BITS) if not masks[path] >> b & 1]
            if len(free) <= radius:  # at most 2 ** radius distinct fingerprints are left
                continue
            parents[path] = []
            for block in _blocks(free, radius + 1):
                masks[len(masks)] = masks[path] | block
                parents[path].append(len(masks) - 1)
        if not parents:
            break
        waiting = placed.join(large, ["path", "value"]).select("fingerprint", F.col("path").alias("parent"))
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): a spanning forest of each shard's links. ``distinct`` holds each fingerprint once."""

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, edges = None, [], []
        for batch in batches:
            for path, value, found in zip(batch["path"].tolist(), batch["value"].tolist(), batch["fingerprint"].tolist()):
                if (path, value) != at:
                    edges += forest(held, radius)
                    at, held = (path, value), []
                held.append(found)
            yield pd.DataFrame(edges, columns=["a", "b"], dtype="int64")
            edges = []
        yield pd.DataFrame(forest(held, radius), columns=["a", "b"], dtype="int64")

    dealt = shards(distinct, radius, shard_rows).repartition("path", "value").sortWithinPartitions("path", "value", "fingerprint")
    return dealt.mapInPandas(searched, "a long, b long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) with the smallest node of each component as root, for all nodes that have an edge.

    Alternates large and small stars until the edges are stars already; each round is a few aggregations with map-side
    combine and joins on the node, whatever the size of a component.
    """
    current = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    state = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Stored, so that the join can split the rows of a node with very many neighbours.
        first = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(first, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-star")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        before, current = current, stored(
            small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges",
        )
        discard(before, first, large, least)
        now = tuple(current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = now


def group_fingerprints(rows: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(fingerprint, root) for each distinct fingerprint of the stored frame ``rows``."""
    distinct = stored(rows.select("fingerprint").distinct(), "fingerprints")
    roots = connected(links(distinct, radius, shard_rows))
    return distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root")
    )


def assign(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, radius: int = RADIUS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document; component_id is the smallest doc_id of its group.

    - Texts that are null, empty or white space have fingerprint 0 and are linked like any other.
    - A null id never becomes the smallest; a group of null ids only has a null component_id.
    - Repeated rows give repeated rows; an empty table gives none; other columns of ``docs`` play no part.
    """
    rows = stored(
        docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text), words).alias("fingerprint")), "simhash"
    )
    members = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    grouped = group_fingerprints(rows, radius, shard_rows).join(members, "fingerprint")
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    known = stored(grouped.join(least, "root").select("fingerprint", "component_id"), "components")
    return rows.join(known, "fingerprint").select("doc_id", "fingerprint", "component_id")


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def deduplicate(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, radius: int = RADIUS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, null ids last, then of the smallest text hash.

    Rows that repeat both id and text leave one row.
    """
    rows = stored(docs.select(
        F.col(doc_id).alias("doc_id"), row_key(text).alias("key"), fingerprint_column(F.col(text), words).alias("fingerprint")
    ), "simhash")
    return keep_first(docs, rows, group_fingerprints(rows, radius, shard_rows), text, doc_id)


def row_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def keep_first(docs: DataFrame, rows: DataFrame, groups: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``docs`` with the first row of each group, by ``rows`` (doc_id, key, fingerprint) and ``groups`` (fingerprint, root)."""
    key = row_key(text)
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    members = rows.groupBy("fingerprint").agg(F.min(order).alias("own_first"))
    grouped = groups.join(members, "fingerprint")
    first = grouped.groupBy("root").agg(F.min("own_first").alias("first"))
    known = stored(grouped.join(first, "root").select(
        "fingerprint", F.col("first.doc_id").alias("first_id"), F.col("first.key").alias("first_key")
    ), "components")
    joined = rows.join(known, "fingerprint")
    stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key"))
    counted = stored(joined.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("rows"), F.bool_or(stays).alias("stays")), "decisions")
    discard(known)

    own_key = free_name(docs.columns, "text_key")
    keyed = docs.withColumn(own_key, key).alias("d")
    same = lambda side: F.col(f"d.`{doc_id}`").eqNullSafe(F.col(f"{side}.doc_id")) & (F.col(f"d.`{own_key}`") == F.col(f"{side}.key"))
    dropped = counted.filter("not stays").select("doc_id", "key")
    if dropped.count() <= BROADCAST_ROWS:  # ids and keys; beyond that, texts meet them in a shuffle
        dropped = F.broadcast(dropped)
    kept = keyed.join(dropped.alias("x"), same("x"), "left_anti")
    repeated = counted.filter("stays and rows > 1")
    if not repeated.isEmpty():
        once = kept.alias("d").join(repeated.alias("y"), same("y"), "left_anti")
        kept = once.unionByName(kept.alias("d").join(repeated.alias("y"), same("y"), "left_semi").dropDuplicates([doc_id, own_key]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
