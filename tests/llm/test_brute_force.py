"""Queries and operators against plain Python on small tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

import corpus_pipeline
from varloom.llm import decontaminate, hmm, language_id, line_dedup, mixing, queries, secret_scan, simhash

from .test_near_dedup import plain_first

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- 1 -------------------------------------------------------------------------------------------


def distance_to_best_place(pattern, text, anchored=False):
    column, best = list(range(len(pattern) + 1)), (len(pattern), 0)
    for j, c in enumerate(text, 1):
        new = [j if anchored else 0]
        for i, p in enumerate(pattern):
            new.append(min(column[i + 1] + 1, new[-1] + 1, column[i] + (p != c)))
        column = new
        if column[-1] < best[0]:
            best = (column[-1], j)
    return best


def test_bit_parallel_distance():
    draw = random.Random(1)
    for _ in range(500):
        pattern = "".join(draw.choice("abc ") for _ in range(draw.randint(1, 90)))
        text = "".join(draw.choice("abc ") for _ in range(draw.randint(0, 60)))
        for anchored in (False, True):
            got = decontaminate.best_match(decontaminate.rows_by_character(pattern), len(pattern), text, anchored)
            assert got == distance_to_best_place(pattern, text, anchored)


def test_items_with_edits_are_found():
    """Every item within its budget is found with its least distance, and no other."""
    draw = random.Random(2)
    words = "ab cd ba dc abc bcd aa dd cab".split()
    for _ in range(60):
        items = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(8, 14)))) for i in range(4)]
        text = " ".join(draw.choice(words) for _ in range(60))
        altered = list(items[0][1])
        for _ in range(draw.randint(0, 6)):
            at = draw.randrange(len(altered))
            altered[at:at + draw.randint(0, 1)] = draw.choice(["", "a", "x", " "])
        at = draw.randint(0, len(text))
        text = text[:at] + " " + "".join(altered) + " " + text[at:]
        got = {key: distance for key, _, _, distance in decontaminate.Matcher(items, 0.15).find(text)}
        own = decontaminate.plain(text)
        expected = {k: distance_to_best_place(t, own)[0] for k, t in items}
        assert got == {k: d for k, d in expected.items() if d <= int(0.15 * len(dict(items)[k]))}


def test_places_are_offsets_into_the_text():
    item = "one two three four five six seven eight nine ten"
    text = "  Hello — ONE, two; three\n\nfour 'five' six seven... eight nyne (ten)! bye"
    (_, start, end, distance), = decontaminate.Matcher([(5, item)], 0.1).find(text)
    assert text[start:end] == "ONE, two; three\n\nfour 'five' six seven... eight nyne (ten" and distance == 1


def test_benchmark_in_documents(spark, sf, documents):
    items = {r.item_id: decontaminate.plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.distance for r in queries.op1_decontaminate(spark, sf).collect()}
    exact = {(d, i) for d, r in documents.items() for i, t in items.items() if t in decontaminate.plain(r.text)}
    assert exact and {k for k, distance in got.items() if distance == 0} == exact
    for (d, i), distance in got.items():
        assert distance_to_best_place(items[i], decontaminate.plain(documents[d].text))[0] == distance <= len(items[i]) // 10


# --- 4 -------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = WORD.findall(lower(text))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=2):
    root = {d: d for d in prints}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {d: top(d) for d in prints}


def test_simhash_query(spark, sf, documents):
    prints = {d: plain_fingerprint(r.text) for d, r in documents.items()}
    groups = plain_groups(prints)
    assert len(set(groups.values())) < len(groups)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash_near_dedup(spark, sf).collect()}
    assert got == {d: (format(p, "016x"), groups[d]) for d, p in prints.items()}


@pytest.mark.parametrize("shard_rows", [2, 10_000])
def test_dense_groups_lose_no_link(spark, shard_rows):
    """Chains and balls of fingerprints whose shards must be dealt again and again."""
    draw = random.Random(3)
    values = set()
    for _ in range(6):
        at = draw.getrandbits(64)
        for _ in range(40):
            values.add(at)
            if draw.random() < 0.7:
                at ^= 1 << draw.randrange(64)
            if draw.random() < 0.7:
                at ^= 1 << draw.randrange(64)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    got = {r.fingerprint: r.root for r in simhash.group_fingerprints(rows, 2, shard_rows).collect()}
    expected = plain_groups({v: v & 0xFFFFFFFFFFFFFFFF for v in signed})
    assert set(got) == set(signed)
    together = lambda groups: {frozenset(g) for g in _inverted(groups).values()}
    assert together(got) == together(expected)


def _inverted(groups):
    members = defaultdict(set)
    for member, root in groups.items():
        members[root].add(member)
    return members


def test_tree_search():
    draw = random.Random(4)
    values = [draw.getrandbits(10) for _ in range(300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 1024, 7):
        assert sorted(tree.within(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


# --- 6 -------------------------------------------------------------------------------------------


def test_line_query(spark, sf, documents):
    """The same templates, one line after the other."""

    def key(line):
        line = re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ")
        return " ".join("<*>" if re.search("[0-9]", t) else t for t in line.split(" "))

    leaf = lambda k: (k.count(" "), *k.split(" ")[:line_dedup.DEPTH])
    least, holders = 4, defaultdict(set)
    for d, r in documents.items():
        for line in r.text.split("\n"):
            if key(line):
                holders[key(line)].add(d)
    leaves, tokens = defaultdict(set), Counter()
    for k, ds in holders.items():
        leaves[leaf(k)] |= ds
        for at, token in enumerate(k.split(" ")):
            tokens[leaf(k), at, token] += len(ds)
    template, shared = {}, defaultdict(set)
    for k, ds in holders.items():
        fixed = [t if t != "<*>" and tokens[leaf(k), at, t] >= least else "<*>" for at, t in enumerate(k.split(" "))]
        if len(leaves[leaf(k)]) >= least and sum(t != "<*>" for t in fixed) / len(fixed) >= line_dedup.MIN_FIXED:
            template[k] = (leaf(k), *fixed)
            shared[template[k]] |= ds
    some = 0
    for r in line_dedup.drop_recurring_lines(spark.read.parquet(f"{sf}/documents.parquet"), min_documents=least).collect():
        lines = r.text.split("\n")
        gone = [i for i, l in enumerate(lines) if len(shared.get(template.get(key(l)), ())) >= least]
        some += len(gone)
        assert (r.n_lines, r.dropped_lines, r.clean_text) == (len(lines), gone, "\n".join(l for i, l in enumerate(lines) if i not in gone))
    assert some


# --- 7 -------------------------------------------------------------------------------------------


def checksums(texts):
    """(id, start, n, crc) of (id, text) in the given order, each text encoded whole."""
    from tokenizers import Tokenizer

    tokenizer, start, rows = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for doc_id, text in texts:
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [2], "<u4")
        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return rows


def test_token_query(spark, sf, documents):
    got = [tuple(r) for r in queries.op7_token_output(spark, sf).orderBy("doc_id").collect()]
    assert got == checksums((d, documents[d].text) for d in sorted(documents))


# --- 8 -------------------------------------------------------------------------------------------


def test_forward_and_backward_against_all_paths():
    draw = np.random.default_rng(0)
    model = hmm.Hmm(draw.dirichlet([1] * 3), draw.dirichlet([1] * 3, size=3), draw.dirichlet([1] * 5, size=3).T.astype(np.float32))
    sequences = [draw.integers(0, 5, n).astype(np.int32) for n in (1, 4, 3, 5, 2, 4)]
    starts, moves, emissions, chances = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), []
    for s in sequences:
        paths = {}
        for path in itertools.product(range(3), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for a, b, symbol in zip(path, path[1:], s[1:]):
                p *= model.move[a, b] * model.emit[symbol, b]
            paths[path] = p
        total = sum(paths.values())
        chances.append(math.log10(total))
        for path, p in paths.items():
            starts[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / total
            for symbol, state in zip(s, path):
                emissions[symbol, state] += p / total
    assert np.allclose(hmm.log10_likelihoods(model, sequences), chances, atol=1e-5)
    for got, expected in zip(hmm.expected_counts(model, sequences), (starts, moves, emissions)):
        assert np.allclose(got, expected, atol=1e-4)


def test_long_sequences_keep_scale():
    draw = np.random.default_rng(1)
    model = hmm.Hmm(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.7, 0.1], [0.3, 0.9]], np.float32))
    sequence = draw.integers(0, 2, 30_000).astype(np.int32)
    state, total = model.start * model.emit[sequence[0]], 0.0
    for symbol in sequence[1:]:
        total += math.log10(state.sum())
        state = (state / state.sum()) @ model.move * model.emit[symbol]
    total += math.log10(state.sum())
    assert abs(hmm.log10_likelihoods(model, [sequence[:10], sequence])[1] - total) < 1e-4 * abs(total)


def test_score_query(spark, sf, documents):
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    tokens = {d: [*WORD.findall(lower(r.text)), None] for d, r in documents.items()}
    counts = Counter(t for d, ts in tokens.items() if not held(d) for t in ts)
    total, distinct = sum(counts.values()), len(counts)
    rows = queries.op8_hmm_scores(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(documents)
    for r in rows:
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens[r.doc_id])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(tokens[r.doc_id]), total)
        assert r.n_known == sum(counts[t] > 0 for t in tokens[r.doc_id])
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_words_outside_the_head_score_alike(spark, documents):
    """The table of counts is joined for them; a head of any size must give the same base score."""
    docs = spark.createDataFrame([(d, documents[d].text) for d in sorted(documents)[:40]], "doc_id long, text string")
    base = lambda head: {r.doc_id: (round(r.base_score, 6), r.n_known) for r in hmm.score_documents(docs, states=2, passes=1, head_words=head).collect()}
    assert base(50) == base(1 << 17)


# --- 9 -------------------------------------------------------------------------------------------


def test_forest_tells_planted_secrets_from_harmless_values(spark):
    """Held-out accuracy on findings whose labels are known and not made by the rules."""
    draw = random.Random(5)
    text = lambda n, letters: "".join(draw.choice(letters) for _ in range(n))
    rows = []
    for i in range(400):
        if i % 2:
            value = text(32, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
            rows.append((i, f"please store the access {draw.choice(['key', 'credential'])} {value} safely", "src/app.py", 1))
        else:
            value = f"chapter-{draw.randint(1, 99)}-of-the-quick-brown-fox"
            rows.append((i, f"the brown fox and the quick page {value} of the quick book", "docs/index.md", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string, known int")
    corpus = secret_scan.corpus_of(docs)
    findings = secret_scan.find_candidates(docs, corpus).drop("label").join(docs.selectExpr("doc_id", "known AS label"), "doc_id")
    judged = secret_scan.judge(findings, findings["doc_id"] % 5 != 0).filter("doc_id % 5 = 0").collect()
    assert len(judged) == 80 and sum(r.is_secret == bool(r.label) for r in judged) >= 78


def test_secret_query(spark, sf, documents):
    expected = Counter()
    for d, r in documents.items():
        spans = {m.span() for m in re.finditer(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}", r.text) if re.search("[0-9]", m[0])}
        for form in (r"(AKIA|ASIA)[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{36,}", r"AIza[0-9A-Za-z_\-]{35}", r"xox[abprs]-[0-9A-Za-z\-]{10,}", r"sk_live_[0-9a-zA-Z]{24,}"):
            spans |= {m.span() for m in re.finditer(form, r.text)}
        for name in ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key"):
            for m in re.finditer(name + r"""["']?[ \t]*[=:][ \t]*(["']?)""", r.text, re.IGNORECASE):
                end = re.compile(re.escape(m[1]) if m[1] else r"""[\s"',;]|\Z""").search(r.text, m.end())
                if end and end.start() > m.end() and "\n" not in r.text[m.end():end.start()]:
                    spans.add((m.end(), end.start()))
        for a, b in spans:
            expected[d, a, b, hashlib.sha256(r.text[a:b].encode()).hexdigest()] += 1
    got = queries.op9_secret_scan(spark, sf).collect()
    assert Counter((r.doc_id, r.start, r.end, r.sha256) for r in got) == expected
    judged = [r for r in got if r.held_out and r.label is not None] or [r for r in got if r.label is not None]
    assert sum(r.is_secret == bool(r.label) for r in judged) >= 0.95 * len(judged)


# --- 10 ------------------------------------------------------------------------------------------


def test_language_query(spark, sf, documents):
    got = queries.op10_language_id(spark, sf).collect()
    assert {r.doc_id for r in got} == set(documents)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_penalties_keep_few_weights():
    draw = np.random.default_rng(2)
    rows = [(i % 2, np.array([i % 2, 2 + draw.integers(50)]), np.array([1.0, 0.3])) for i in range(200)]
    loose, tight = (np.count_nonzero(language_id.ftrl(rows, 2, 60, l1=l1)) for l1 in (0.0, 1.5))
    assert 0 < tight < loose


def test_temperature_calibrates():
    draw = np.random.default_rng(3)
    labels = draw.integers(0, 2, 4000)
    sure = np.where(draw.random(4000) < 0.8, labels, 1 - labels)  # right in four of five cases
    logits = 10.0 * np.eye(2)[sure]
    assert abs(language_id.softmax(logits / language_id.temperature_of(logits, labels)).max(axis=1).mean() - 0.8) < 0.02


# --- the pipeline --------------------------------------------------------------------------------


def holds(item, text):
    """Whether the item occurs within a tenth of its length; only texts that share a twelve-letter part are compared, which
    an occurrence could avoid only by edits in nearly every such part."""
    shared = any(item[i:i + 12] in text for i in range(len(item) - 11))
    return shared and distance_to_best_place(item, text)[0] <= len(item) // 10


def test_pipeline_against_brute_force(spark, sf, documents):
    """Each stage's decisions by plain Python; the model's labels, which the language test holds, come from its query."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    # 1. The same rows train the same model as in the query.
    judged = {r.doc_id: (r.lang_pred, r.score) for r in queries.op10_language_id(spark, sf).collect()}
    kept = [d for d in sorted(documents) if judged[d][0] != "und" and judged[d][1] >= corpus_pipeline.LEAST_SCORE]
    # 2.
    kept = sorted(plain_first({d: documents[d].text for d in kept}))
    # 3.
    items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = [d for d in kept if not any(holds(t, decontaminate.plain(documents[d].text)) for t in items)]
    # 4.
    size = {d: len(WORD.findall(documents[d].text)) for d in kept}
    sources = defaultdict(list)
    for d in kept:
        sources[documents[d].source].append(d)
    words = {s: sum(size[d] for d in ds) for s, ds in sources.items()}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sources))}
    full, budget = set(), 1.5 * sum(words.values())
    while True:  # the excess of full sources goes to the others, until none is above
        left = budget - sum(2 * words[s] for s in full)
        level = left / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in sources if s not in full and weight[s] * level > 2 * words[s]}
        if not more:
            break
        full |= more
    copies = {}
    for s, ds in sources.items():
        target = 2.0 * words[s] if s in full else weight[s] * level
        whole = int(target / words[s])
        need, taken = target - whole * words[s], 0
        draws = {d: hashlib.md5(f"{mixing.SEED}:{d}:{documents[d].text}".encode()).hexdigest() for d in ds}
        for d in sorted(ds, key=draws.get):
            extra = whole < 2 and taken + size[d] / 2 <= need
            copies[d], taken = whole + extra, taken + size[d]
    # 5.
    mixed = [d for d in kept for _ in range(copies[d])]
    expected = checksums((d, documents[d].text) for d in mixed)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == sorted(expected)
    assert [name for name, _ in corpus_pipeline.STAGES] and docs.count() > len(set(mixed)) > 0
