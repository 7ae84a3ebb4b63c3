"""Lines that are the same in many documents, whatever share of their tokens holds digits."""

import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from varloom.llm import line_dedup, queries


def test_repeats_full_of_digits_go(spark):
    repeated = ["Page 3 of 12", "Tel 555-0100 Fax 555-0199", "(c) 2024", "1 2 3 4 5", "a <*>"]
    other = lambda i: [f"Page {i} of 99{i}", f"(c) 1{i}", f"{i} {i} {i}"]
    texts = ["\n".join(["kept", *repeated[:2], *other(i), *repeated[2:], " (c)\t2024 "]) for i in range(10)]
    texts += ["\n".join(["Page 7 of 7"] * 20)] + ["(c) 1999"] * 9
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.dropped_lines for r in line_dedup.drop_recurring_lines(docs).collect()}
    assert all(got[i] == ([0] if i < 10 else []) + ([1, 2, 6, 7, 8, 9] if i < 10 else []) for i in range(20))
    found = line_dedup.recurring_lines(docs).collect()
    assert len(found) == len({(r.doc, r.line_no) for r in found}) == 70
    plain = lambda line: " ".join("<*>" if any(c.isdigit() for c in t) else t for t in line.split())
    assert {r.template for r in found} == {"kept", *map(plain, repeated)}
    assert all(not d for d in (r.dropped_lines for r in line_dedup.drop_recurring_lines(docs, min_documents=21).collect()))


def test_long_passages_go_from_all_texts_but_one(spark, tmp_path):
    word = lambda i: chr(97 + i % 26) + chr(97 + i // 26)
    passage = " ".join(f"word{word(i)}" for i in range(60))
    changing = [" ".join(f"other{word(i)}" for i in range(60)).replace("otherha", w) for w in ("this", "that", "these")]
    short = " ".join(passage.split()[:49])
    texts = [f"{passage}\n{short}\nalpha", f"beta\n{passage}\n{short}", *[f"{c}\n{w}" for c, w in zip(changing, ("gamma", "delta", "mu"))]]
    texts += [f"{passage.upper()}\nepsilon"] * 2  # copies of one text, which no other text shares
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.dropped_lines for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()}
    assert sorted([got[0] == [0], got[1] == [1]]) == [False, True]
    assert sorted(got[i] for i in (2, 3, 4)) == [[], [0], [0]] and sum(map(len, got.values())) == 3
    found = line_dedup.recurring_lines(docs, passage_texts=2).collect()
    assert sorted(r.documents for r in found) == [2, 2, 3, 3, 3] and sum(r.stays for r in found) == 2
    assert {r.template for r in found} == {passage, changing[0].replace("this", "<*>")}


@pytest.mark.parametrize("leaf_lines, broadcast_rows", [(2_000, 2_000_000), (0, 0)])
def test_query_settings_against_plain_python(spark, sf, monkeypatch, leaf_lines, broadcast_rows):
    """The query's own numbers with passages, one line after the other, whatever way the leaves go."""
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", broadcast_rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    # Short lines of ten documents, some with digits; long lines that two texts share as a whole or but for some words.
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    passages = [[word() for _ in range(draw.randint(45, 75))] for _ in range(12)]
    for i in range(60):
        lines = [f"Page {i} of 60", "All rights reserved 2024", word()] * draw.randint(0, 1)
        for passage in draw.sample(passages, 2):
            changed = list(passage)
            for at in range(3, len(changed)):
                if draw.random() < draw.choice([0, 0.02, 0.5]):
                    changed[at] = word()
            lines.append(" ".join(changed))
        rows.append((10_000 + i, "\n".join(lines)))
    rows += [rows[-1], (20_000, rows[-1][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.text): r.dropped_lines for r in line_dedup.drop_recurring_lines(frame, passage_texts=2, leaf_lines=leaf_lines).collect()}
    assert got == plain_drops(set(rows), 10, 0.6, 50, 2)


def plain_drops(rows, least, min_fixed, words, texts):
    spaced = lambda line: re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ")
    plain = lambda line: " ".join("<*>" if re.search("[0-9]", t) else t for t in spaced(line).split(" "))
    leaf = lambda k: (k.count(" "), *k.split(" ")[:line_dedup.DEPTH])
    drops = {row: set() for row in rows}
    lines = [(row, i, plain(l), spaced(l)) for row in rows for i, l in enumerate((row[1] or "").split("\n")) if spaced(l)]
    key_of = {text: _signed_hash(text) for _, text in rows}
    for holder, need, fixed_words in (("doc", least, 1), ("text", texts, words)):
        own = lambda row: row if holder == "doc" else row[1]
        held, of_leaf = defaultdict(set), defaultdict(set)
        for row, _, key, _ in lines:
            held[key].add(own(row))
            of_leaf[leaf(key)].add(own(row))
        counts = Counter()
        for key, owners in held.items():
            for at, token in enumerate(key.split(" ")):
                counts[leaf(key), at, token] += len(owners)
        template, shared = {}, defaultdict(set)
        for key, owners in held.items():
            fixed = [t if t != "<*>" and counts[leaf(key), at, t] >= need else "<*>" for at, t in enumerate(key.split(" "))]
            n = sum(t != "<*>" for t in fixed)
            if len(of_leaf[leaf(key)]) >= need and n >= fixed_words and n / len(fixed) >= min_fixed and (holder == "doc" or len(fixed) >= words):
                template[key] = (leaf(key), *fixed)
                shared[template[key]] |= owners
        for row, i, key, _ in lines:
            owners = shared.get(template.get(key), ())
            if len(owners) >= need and (holder == "doc" or row[1] != min(owners, key=key_of.get)):
                drops[row].add(i)
    same = defaultdict(set)
    for row, _, key, line in lines:
        tokens = key.split(" ")
        if "<*>" in tokens and sum(t != "<*>" for t in tokens) / len(tokens) < min_fixed:
            same[line].add(row)
    for row, i, _, line in lines:
        if len(same.get(line, ())) >= least:
            drops[row].add(i)
    return {row: sorted(numbers) for row, numbers in drops.items()}


def _signed_hash(text):
    value = xxhash.xxh64_intdigest((text or "").encode(), 42)  # as Spark hashes a string
    return value - (1 << 64) if value >> 63 else value
