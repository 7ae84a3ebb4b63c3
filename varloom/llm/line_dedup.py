"""Lines that recur across documents, found by a log-template tree of fixed depth.

A line's way through the tree is its number of tokens, then its first ``depth`` tokens; tokens with digits are variable
fields from the start. The lines of a leaf are generalised position by position: a token stays where enough documents
of the leaf agree on it, and becomes a variable field elsewhere. A template that enough documents share, and that
still fixes enough of its tokens, is boilerplate, and its lines are dropped from all of them. A line whose own text is in
enough documents is boilerplate too, however many of its tokens hold digits.

Fewer documents are enough for a passage, a line that fixes ``PASSAGE_WORDS`` tokens: chance repeats no such line. Passages
are content and not boilerplate, so one text keeps its lines, and they are counted by distinct texts, as copies of whole
texts repeat nothing inside them.

Texts are read twice. The first reading leaves eight-byte hashes of leaves and lines, which tell the leaves that enough
documents share; the second sends the lines of these leaves only, each once. A leaf's distinct lines are generalised by the
task they meet in. A leaf of more than ``LEAF_LINES`` of them is never held: its tokens are keys of aggregations, so a leaf
with a third of all lines is many rows of a shuffle and not one task's list.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from varloom.llm.common import free_name, stored
from varloom.llm.words import texts_of

DEPTH = 3
MIN_DOCUMENTS = 10
MIN_FIXED = 0.6
PASSAGE_WORDS = 50
PASSAGE_TEXTS = 2
VARIABLE = "<*>"
LEAF_LINES = 2_000
BROADCAST_ROWS = 2_000_000

_DIGIT = re.compile(rb"[0-9]")
_VARIABLE = VARIABLE.encode()
_OFTEN, _PASSAGE = 0, 1


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _key_of(doc_id: str, text: str) -> Column:
    """The same for rows that repeat id and text, which then share every decision."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("-")), F.coalesce(F.col(f"`{text}`"), F.lit("")))))


def parsed_lines(text: str | None, depth: int) -> Iterator[tuple[int, list[bytes], list[bytes], int, int]]:
    """(number, own tokens, tokens with digits as variable fields, leaf, line) of each line of ``text`` that is not blank."""
    hashed = xxhash.xxh64_intdigest
    for number, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        own = line.split()  # at ASCII white space
        if own:
            tokens = [_VARIABLE if _DIGIT.search(t) else t for t in own] if _DIGIT.search(line) else own
            yield number, own, tokens, _signed(hashed(b"%d " % len(tokens) + b" ".join(tokens[:depth]))), _signed(hashed(b" ".join(tokens)))


def _line_keys(docs: DataFrame, depth: int, min_fixed: float) -> DataFrame:
    """(doc, text_key, lines) of ``docs`` (doc, text_key, text); a line is (line_no, leaf, line, tokens, own).

    ``own`` is a hash of the line as it is, where it fixes too few tokens whatever other lines hold, else null.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_of(batches):
            offsets, numbers, leaves, lines, sizes, owns = [0], [], [], [], [], []
            for text in texts:
                for number, own, tokens, leaf, line in parsed_lines(text, depth):
                    numbers.append(number)
                    leaves.append(leaf)
                    lines.append(line)
                    sizes.append(len(tokens))
                    variable = tokens.count(_VARIABLE)
                    owns.append(_signed(xxhash.xxh64_intdigest(b" ".join(own))) if variable and (len(tokens) - variable) / len(tokens) < min_fixed else None)
                offsets.append(len(numbers))
            columns = [pa.array(x, t) for x, t in ((numbers, pa.int32()), (leaves, pa.int64()), (lines, pa.int64()), (sizes, pa.int32()), (owns, pa.int64()))]
            rows = pa.StructArray.from_arrays(columns, names=["line_no", "leaf", "line", "tokens", "own"])
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("text_key"), listed], names=["doc", "text_key", "lines"])

    return docs.mapInArrow(
        found, "doc binary, text_key long, lines array<struct<line_no:int, leaf:long, line:long, tokens:int, own:long>>"
    )


def _line_texts(docs: DataFrame, leaves: DataFrame, depth: int) -> DataFrame:
    """(leaf, line, text): the lines of ``docs`` (text) whose leaf is in the stored frame ``leaves``; a task sends each once."""
    asked = None
    if leaves.count() <= BROADCAST_ROWS:  # eight bytes each; beyond that, lines and leaves meet in a shuffle
        asked = docs.sparkSession.sparkContext.broadcast(np.sort(leaves.select("leaf").toArrow()["leaf"].to_numpy()))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if asked is None else set(asked.value.tolist())
        sent: set[tuple[int, int]] = set()
        for _, texts in texts_of(batches):
            rows = []
            for text in texts:
                for _, _, tokens, leaf, line in parsed_lines(text, depth):
                    if (wanted is None or leaf in wanted) and (leaf, line) not in sent:
                        sent.add((leaf, line))
                        rows.append((leaf, line, b" ".join(tokens)))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()).cast(pa.string())],
                names=["leaf", "line", "text"],
            )

    lines = docs.select("text").mapInArrow(found, "leaf long, line long, text string")
    return lines if asked is not None else lines.join(leaves.select("leaf"), "leaf", "left_semi")


def templates_of(lines: list[tuple[int, str, int]], least: int, min_fixed: float, fixed_words: int) -> Iterator[tuple[int, str]]:
    """(line, template) of those lines (line, text, holders) of one leaf that fix enough tokens."""
    if sum(holders for _, _, holders in lines) < least:
        return
    split = [text.split(" ") for _, text, _ in lines]
    agreed: list[Counter] = [Counter() for _ in split[0]]
    for tokens, (_, _, holders) in zip(split, lines):
        for counts, token in zip(agreed, tokens):
            counts[token] += holders
    for tokens, (line, _, _) in zip(split, lines):
        kept = [t if t != VARIABLE and counts[t] >= least else VARIABLE for counts, t in zip(agreed, tokens)]
        fixed = len(kept) - kept.count(VARIABLE)
        if fixed >= fixed_words and fixed / len(kept) >= min_fixed:
            yield line, " ".join(kept)


def _small_leaves(lines: DataFrame, limits: dict[int, tuple[int, int]], min_fixed: float) -> DataFrame:
    """(leaf, line, kind, template) of ``lines`` (leaf, line, text, often, passages) whose leaves fit a task."""

    def of_leaf(leaf: int, rows: list[dict]) -> Iterator[tuple[int, int, int, str]]:
        for kind, (least, fixed_words) in limits.items():
            own = [(r["line"], r["text"], r["held"][kind]) for r in rows if r["held"][kind]]
            if own:
                yield from ((leaf, line, kind, template) for line, template in templates_of(own, least, min_fixed, fixed_words))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            columns = list(zip(*rows)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["leaf", "line", "kind", "template"]
            )

        at, held, out = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                row["held"] = (row["often"], row["passages"])
                if row["leaf"] != at:
                    if held:
                        out += of_leaf(at, held)
                    at, held = row["leaf"], []
                held.append(row)
            yield batch_of(out)
            out = []
        yield batch_of(list(of_leaf(at, held)) if held else [])

    dealt = lines.select("leaf", "line", "text", "often", "passages").repartition("leaf").sortWithinPartitions("leaf", "line")
    return dealt.mapInArrow(found, "leaf long, line long, kind int, template string")


def _large_leaf(lines: DataFrame, kind: int, holders: str, least: int, min_fixed: float, fixed_words: int) -> DataFrame:
    """The same for leaves of any size: a row of a shuffle for each token."""
    cells = lines.filter(F.col(holders) > 0).select("leaf", "line", F.col(holders).alias("n"), F.posexplode(F.split("text", " ")).alias("at", "token"))
    common = stored(
        cells.groupBy("leaf", "at", "token").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) & (F.col("token") != VARIABLE))
        .select("leaf", "at", "token", F.lit(True).alias("fixed")), "common-tokens",
    )
    # A line has as many cells as tokens.
    ordered = F.array_sort(F.collect_list(F.struct("at", F.when(F.col("fixed"), F.col("token")).otherwise(F.lit(VARIABLE)).alias("token"))))
    return cells.join(common, ["leaf", "at", "token"], "left").groupBy("leaf", "line").agg(
        F.array_join(F.transform(ordered, lambda c: c["token"]), " ").alias("template"), F.count("fixed").alias("fixed"),
        (F.count("fixed") / F.count(F.lit(1))).alias("share"),
    ).filter((F.col("share") >= min_fixed) & (F.col("fixed") >= fixed_words)).select("leaf", "line", F.lit(kind).alias("kind"), "template")


def recurring_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", depth: int = DEPTH, min_documents: int = MIN_DOCUMENTS,
    min_fixed: float = MIN_FIXED, passage_words: int = PASSAGE_WORDS, passage_texts: int | None = None, leaf_lines: int = LEAF_LINES,
) -> DataFrame:
    """(doc, line_no, template, documents, stays): every line whose template recurs, with the documents that share it.

    ``stays`` marks the lines of a passage in the one text that keeps them: that of the smallest hash. A passage counts
    distinct texts in place of documents; a line that recurs by both rules has two rows. Without ``passage_texts`` there
    are no passages, and one number holds for lines of all lengths.

    A line that fixes too few tokens for a template, but is itself in ``min_documents`` documents, is its own template, with
    its digits as variable fields. ``doc`` is a digest of id and text. Lines of a document count once per template.
    """
    own = docs.select(_key_of(doc_id, text).alias("doc"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text_key"), F.col(f"`{text}`").alias("text"))
    keys = stored(_line_keys(own, depth, min_fixed), "line-keys")
    # A template needs min_documents documents, or a leaf of long lines and several texts: most lines never go further.
    leaves_of = F.array_distinct(F.transform("lines", lambda l: F.struct(l["leaf"].alias("leaf"), (l["tokens"] >= passage_words).alias("long"))))
    leaves = stored(
        keys.select(F.explode(leaves_of).alias("at"), "text_key").groupBy("at.leaf", "at.long").agg(
            F.count(F.lit(1)).alias("n"), F.min("text_key").alias("low"), F.max("text_key").alias("high")
        ).select(
            "leaf", (F.col("n") >= min_documents).alias("often"),
            (F.col("long") & F.lit(passage_texts is not None) & (F.col("n") >= (passage_texts or 0)) & (F.col("low") != F.col("high"))).alias("passages"),
        ).filter("often or passages"), "leaves",
    )
    placed = stored(keys.select("doc", "text_key", F.inline("lines")).drop("tokens").join(leaves, "leaf"), "leaf-lines")
    in_documents = placed.filter("often").select("leaf", "line", "doc").distinct().groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("often"))
    in_texts = placed.filter("passages").select("leaf", "line", "text_key").distinct().groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("passages"))
    held = in_documents.join(in_texts, ["leaf", "line"], "full").fillna(0, ["often", "passages"])
    texts = _line_texts(own, leaves, depth).dropDuplicates(["leaf", "line"])
    distinct = stored(texts.join(held, ["leaf", "line"]), "distinct-lines")

    limits = {_OFTEN: (min_documents, 1)} | ({} if passage_texts is None else {_PASSAGE: (passage_texts, passage_words)})
    large = stored(distinct.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > leaf_lines).select("leaf"), "large-leaves")
    if large.isEmpty():
        found = _small_leaves(distinct, limits, min_fixed)
    else:
        found = _small_leaves(distinct.join(large, "leaf", "left_anti"), limits, min_fixed)
        for kind, (least, fixed_words) in limits.items():
            rest = distinct.join(large, "leaf", "left_semi")
            found = found.unionByName(_large_leaf(rest, kind, ("often", "passages")[kind], least, min_fixed, fixed_words))
    # A leaf and a hash tell a template.
    templates = stored(found.withColumn("template_key", F.xxhash64("template")), "line-templates")

    known = placed.join(templates, ["leaf", "line"])
    by = ["leaf", "template_key"]
    shared = lambda holder, least: known.filter(F.col("kind") == (_OFTEN if holder == "doc" else _PASSAGE)).select(*by, holder).distinct().groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"), F.min("text_key" if holder == "text_key" else F.lit(None)).alias("least")
    ).filter(F.col("documents") >= least)
    columns = ["doc", "line_no", "template", "documents", "stays"]
    result = known.filter(F.col("kind") == _OFTEN).join(stored(shared("doc", min_documents), "shared-templates"), by).withColumn("stays", F.lit(False)).select(columns)
    # A line in min_documents documents has all its tokens without digits fixed, so lines that fix too few are the only ones left out above.
    variable = placed.filter("often and own is not null")
    repeated = stored(
        variable.select("doc", "own").distinct().groupBy("own").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") >= min_documents),
        "repeated-lines",
    )
    named = distinct.select("leaf", "line", F.col("text").alias("template"))
    by_text = variable.join(repeated, "own").join(named, ["leaf", "line"]).withColumn("stays", F.lit(False))
    result = result.unionByName(by_text.select(columns))
    if passage_texts is None:
        return result
    passages = known.filter(F.col("kind") == _PASSAGE).join(stored(shared("text_key", passage_texts), "shared-passages"), by)
    return result.unionByName(passages.withColumn("stays", F.col("text_key") == F.col("least")).select(columns))


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines of these numbers."""

    @F.arrow_udf("string")
    def left(texts: pa.Array, drops: pa.Array) -> pa.Array:
        found = []
        for value, numbers in zip(texts.to_pylist(), drops.to_pylist()):
            dropped = set(numbers)
            found.append("\n".join([line for i, line in enumerate(value.split("\n")) if i not in dropped]))
        return pa.array(found, pa.string())

    return left(text, gone)


def drop_recurring_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", depth: int = DEPTH, min_documents: int = MIN_DOCUMENTS,
    min_fixed: float = MIN_FIXED, passage_words: int = PASSAGE_WORDS, passage_texts: int | None = None, leaf_lines: int = LEAF_LINES,
) -> DataFrame:
    """All rows and columns of ``docs`` plus clean_text, n_lines and dropped_lines (line numbers from 0, ascending).

    - A line whose template recurs in ``min_documents`` documents or more is dropped from all of them; so is a line
      that is itself in as many, spaces aside, however few of its tokens are free of digits; blank lines stay, and so does everything else, in order.
    - A line whose template fixes ``passage_words`` tokens and recurs in ``passage_texts`` different texts, if given, is
      dropped from all of them but one, the text of the smallest hash.
    - A null text has 0 lines and a null clean_text; an empty one has one blank line and stays empty.
    - Rows that repeat id and text count as one document and are cleaned alike; an empty table gives no rows.
    - Lines are read whole, however long. Result columns whose names ``docs`` has already get leading underscores.
    """
    found = recurring_lines(docs, text, doc_id, depth, min_documents, min_fixed, passage_words, passage_texts, leaf_lines).filter("not stays")
    # At most as many numbers as the document has lines.
    drops = stored(found.groupBy("doc").agg(F.array_sort(F.collect_set("line_no")).alias("drops")), "drops")
    if (drops.agg(F.sum(F.size("drops") + 4)).first()[0] or 0) <= BROADCAST_ROWS:
        drops = F.broadcast(drops)
    names = {n: free_name(docs.columns, n) for n in ("clean_text", "n_lines", "dropped_lines")}
    own = free_name(docs.columns, "line_owner")
    keyed = docs.withColumn(own, _key_of(doc_id, text))
    value = F.col(f"d.`{text}`")
    joined = keyed.alias("d").join(drops.alias("x"), F.col(f"d.`{own}`") == F.col("x.doc"), "left").select(
        *[F.col(f"d.`{c}`") for c in docs.columns], F.coalesce(F.size(F.split(value, "\n", -1)), F.lit(0)).alias(names["n_lines"]),
        F.coalesce(F.col("x.drops"), F.array().cast("array<int>")).alias(names["dropped_lines"]),
    )
    gone = F.col(names["dropped_lines"])
    # Only texts that lose a line go to a worker as a whole.
    touched = F.when(F.size(gone) > 0, F.col(f"`{text}`")).otherwise(F.lit(""))
    cleaned = joined.withColumn(names["clean_text"], _without(touched, gone))
    return cleaned.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.when(F.size(gone) == 0, F.col(f"`{text}`")).otherwise(F.col(names["clean_text"])).alias(names["clean_text"]), names["n_lines"], names["dropped_lines"],
    )
