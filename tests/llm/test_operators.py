"""The corpus operators against brute force on one awkward table, and their own branches."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from tessera.llm import chat_format, common, decontaminate, line_dedup, mtree, packing, repeats, simhash, substring_dedup, suffix_dedup, textarrays, toxicity, warc
from tests.compare import connect, rows

random.seed(5)
WORDS = ["alpha", "beta", "Gamma", "delta", "été", "naïve", "omega", "x", "1999", "zeta,", "eta.", "Über", "京都"]
BASE = " ".join(random.choice(WORDS) for _ in range(150))
LONG = " ".join(random.choice(WORDS) + str(random.randint(0, 999)) for _ in range(30000))
LINE = "A common line of enough characters"
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace("omega", "OMEGA", 2)), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "a" * 400), (9, "a" * 300 + "b" + "a" * 90),
    (10, LINE + "\nunique ten\n" + LINE), (11, "x\n  " + LINE.upper() + " \ny"), (12, LINE), (13, "pre " + BASE[100:500] + " post"), (14, LONG), (15, "head " + LONG[5000:9000] + "\r\n" + LINE),
    (16, BASE), (None, BASE[:200] + " null id"), (17, "京" * 60 + " " + BASE[:100]), (18, "ab" * 40), (18, "ab" * 40), (19, "\n\n"), (20, BASE + " " + BASE), (21, "short <|endoftext|> text"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Null ids and texts, empty, blank and very long texts, copies, repeated rows, clashing columns."""
    table = [(i, t, "en", "s", len(t or ""), "clash", 7, 1.5, "clash") for i, t in TEXTS]
    return spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, bitmap string, bucket int, score double, component string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def key(i):
    return common.NULL_ID if i is None else i


def multiset(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# packing ---------------------------------------------------------------------------------------
@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("limits", [{}, {"max_docs": 3, "max_attention": 900}])
def test_plan_respects_every_capacity(score, limits):
    counts = Counter(random.randint(1, 30) for _ in range(500))
    plan = packing.best_fit_plan(counts, 40, score=score, weights=(1.0, 0.2, 0.2), **limits)
    used, docs, cost, seen = Counter(), Counter(), Counter(), Counter()
    for length, rank, n, first, per, offset in plan:
        assert rank == seen[length]
        seen[length] += n
        for j in range(n):
            b = first + j // per
            assert used[b] == offset + j % per * length
            used[b] += length
            docs[b] += 1
            cost[b] += length**2
    assert seen == counts and max(used.values()) <= 40 and sorted(used) == list(range(len(used)))
    assert max(docs.values()) <= limits.get("max_docs", 10**9) and max(cost.values()) <= limits.get("max_attention", 10**9)
    if score == "norm" and not limits:
        assert len(used) <= sum(k * n for k, n in counts.items()) / 40 * 1.05 + 1


def item_by_item(counts, full, weights, score):
    """Vector best-fit-decreasing on items: the sequences it takes."""
    bins = []
    for length in sorted(counts, reverse=True):
        item = (length, 1, length * length)
        for _ in range(counts[length]):
            fits = [b for b in bins if all(r >= x for r, x in zip(b, item))]
            norm = lambda b: sum(w * (r - x) ** 2 / f**2 for w, r, x, f in zip(weights, b, item, full))  # noqa: E731, B023
            dot = lambda b: -sum(w * r * x / f**2 for w, r, x, f in zip(weights, b, item, full))  # noqa: E731, B023
            if fits:
                chosen = min(fits, key=norm if score == "norm" else dot)
            else:
                chosen = list(full)
                bins.append(chosen)
            for d in range(3):
                chosen[d] -= item[d]
    return len(bins)


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("full", [(40, 40, 1600), (40, 3, 900)])
def test_plan_takes_as_many_sequences_as_item_by_item(score, full):
    rng = random.Random(3)
    for seed in range(5):
        counts, weights = Counter(rng.randint(1, 30) for _ in range(300)), [(1.0, 0.2, 0.3), packing.WEIGHTS][seed % 2]
        plan = packing.best_fit_plan(counts, *full, weights, score)
        opened = max(first + -(-n // per) for _, _, n, first, per, _ in plan)
        assert abs(opened - item_by_item(counts, full, weights, score)) <= 1  # ties may fall either way
        if full[1] == 40 and weights == packing.WEIGHTS:
            assert opened <= -(-sum(k * n for k, n in counts.items()) // 40) + 1
        packed = packing.best_fit_plan(counts, *full, weights, score, max_states=5)
        assert sum(n for _, _, n, _, _, _ in packed) == 300


def test_packing_is_gapless_and_whole(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs, max_tokens=64).collect()
    want = Counter()
    for i, text in TEXTS:
        ids = [*exact.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 64 or 64, len(ids), 64), len(ids)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack(empty).count() == 0


# chats -----------------------------------------------------------------------------------------
def test_chats(spark):
    turns = [
        (1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"),
        (5, 0, None, None), (6, 0, "", ""), (7, 1, "user", "b"), (7, 0, "user", "a"), (7, 0, "user", "a"), (None, 0, "user", "z"), (8, None, "user", "q"),
    ]
    df = spark.createDataFrame([(*t, "clash", 1) for t in turns], "conv_id long, turn long, role string, text string, t string, place int")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat_format.format_chats(df).collect()}
    line = lambda r, t: f"<|im_start|>{r}\n{t}<|im_end|>\n"
    assert set(got) == {2, 4, 5, 6, 7, None, 8}
    assert got[2] == (2, 2, line("user", "hi") + line("assistant", "yo")) and got[7][2] == line("user", "a") * 2 + line("user", "b")
    assert chat_format.format_chats(df.limit(0)).count() == 0


# repeats ---------------------------------------------------------------------------------------
def brute_removal(units_of, length, join):
    first: dict = {}
    for i, text in TEXTS:
        u = units_of(text)
        for a in range(len(u) - length + 1):
            w = tuple(u[a : a + length])
            first[w] = min(first.get(w, key(i)), key(i))
    out = Counter()
    for i, text in TEXTS:
        u = units_of(text)
        gone = [False] * len(u)
        for a in range(len(u) - length + 1):
            if first[tuple(u[a : a + length])] < key(i):
                gone[a : a + length] = [True] * length
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out[i, len(u), sum(gone), spans, hashlib.sha256(join([x for x, g in zip(u, gone) if not g])).hexdigest()] += 1
    return out


def test_byte_dedup(docs, empty):
    got = multiset(suffix_dedup.dedup_bytes(docs, 50), "doc_id", "n_units", "n_removed", "n_spans", F.sha2("kept", 256))
    assert got == brute_removal(lambda t: (t or "").encode(), 50, bytes)
    got = multiset(suffix_dedup.dedup_bytes(docs, 31), "doc_id", "n_units", "n_removed", "n_spans", F.sha2("kept", 256))
    assert got == brute_removal(lambda t: (t or "").encode(), 31, bytes)
    assert suffix_dedup.dedup_bytes(empty).count() == 0


def test_texts_shorter_than_a_window(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a b"), (3, None)], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.dedup_bytes(df).collect()] == [0] * 3
    assert [r.n_removed for r in substring_dedup.dedup_words(df).collect()] == [0] * 3


def test_suffix_ranks_order_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, depth = int(rng.integers(1, 200)), int(rng.integers(1, 60))
        s = rng.integers(1, 4, n)
        order = np.argsort(suffix_dedup.suffix_ranks(s, depth), kind="stable")
        prefixes = [tuple(s[i : i + depth]) for i in order]
        assert prefixes == sorted(prefixes)


@pytest.mark.parametrize("length", [13, 3])
def test_word_dedup(docs, empty, length):
    got = multiset(substring_dedup.dedup_words(docs, length), "doc_id", "n_units", "n_removed", "n_spans", F.sha2("kept", 256))
    assert got == brute_removal(lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()), length, b" ".join)
    assert substring_dedup.dedup_words(empty).count() == 0
    crowded = repeats.remove_repeats(docs, repeats.Unit("words", length, max(1, length // 3), crowd=1), substring_dedup.shared_edges)
    assert multiset(crowded, "doc_id", "n_units", "n_removed", "n_spans", F.sha2("kept", 256)) == got


def test_unequal_words_and_bytes_that_cancel_out_in_polynomials(spark):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2**64 in any base."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    rest = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup_words(df).collect()} == {1: 0, 2: 0, 3: 13}
    data = np.frombuffer(f"{one} {two}".encode(), np.uint8)
    assert len(set(textarrays.word_hashes(data, np.array([0, 1025]), np.array([1024, 2049])).tolist())) == 2
    short = [w.encode() for w in ("a", "ab", "abc", "b", "ba", "abcdefgh", "abcdefgi", "abcdefgha", "abcdefgh\x00")]
    ends = np.cumsum([len(w) for w in short])
    assert len(set(textarrays.word_hashes(np.frombuffer(b"".join(short), np.uint8), ends - [len(w) for w in short], ends).tolist())) == len(short)


def test_many_contexts_of_one_passage(spark):
    passage = "".join(random.choice("abcdefghij ") for _ in range(90))
    texts = [(i, "".join(random.choice("klmnop ") for _ in range(70)) + passage[: 90 - i % 20] + "".join(random.choice("qrstuv ") for _ in range(70))) for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup_bytes(df, 50).collect()}
    crowded = repeats.remove_repeats(df, repeats.Unit("bytes", 50, 24, crowd=3), suffix_dedup.equal_prefixes)
    assert got == {r.doc_id: r.n_removed for r in crowded.collect()}
    for i, text in texts:
        best = [False] * len(text)
        for a in range(len(text) - 49):
            if any(text[a : a + 50] in other for _, other in texts[:i]):
                best[a : a + 50] = [True] * 50
        assert got[i] == sum(best)
        if i > 60:
            break


def test_chunks_send_together(spark):
    """Many chunks and buckets exchange one row for 16 chunks and a bucket, and lose no window, open, settled or crowded."""
    r = random.Random(11)
    passage = lambda: "".join(r.choice("abcdefghij ") for _ in range(r.randint(60, 200)))
    shared = [passage() for _ in range(40)]
    texts = [(i, passage() + "".join(r.choice(shared)[r.randint(0, 9) :] for _ in range(3)) + passage()) for i in range(900)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    want = multiset(suffix_dedup.dedup_bytes(df, 50), "doc_id", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sum(row[1] > 0 for row in want) > 800
    for crowd in (2048, 3):
        small = repeats.remove_repeats(df, repeats.Unit("bytes", 50, 24, crowd=crowd), suffix_dedup.equal_prefixes, 2048, 1 << 16)
        assert multiset(small, "doc_id", "n_removed", "n_spans", F.sha2("kept", 256)) == want
    data = [t.encode() for _, t in texts[:320]]
    chunk = lambda k: {"chunk": (3 << 32) + k, "ids": np.arange(20, dtype="<i8").tobytes(), "sizes": np.array([len(x) for x in data[20 * k : 20 * k + 20]], "<i8").tobytes(), "text": zstandard.compress(b"".join(data[20 * k : 20 * k + 20]))}
    sent = [r for x in repeats._emit(repeats.Unit("bytes", 50, 24), 30, 4)(iter([pa.RecordBatch.from_pylist([chunk(k) for k in range(16)])])) for r in x.to_pylist()]
    assert len(sent) == len({r["bucket"] for r in sent}) == 30
    assert [repeats.group_bits(n, repeats.CHUNK_BYTES) for n in (0, 1 << 27, 1 << 28, 1 << 31, 1 << 40)] == [0, 0, 1, 4, 4]


# line dedup ------------------------------------------------------------------------------------
def test_lines(docs, empty):
    strip = " \t\n\x0b\x0c\r"
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    holders: dict = {}
    for i, text in TEXTS:
        for line in (text or "").split("\n"):
            k = low(line.strip(strip))
            if len(k) >= 20:
                holders.setdefault(k, set()).add(key(i))
    want = Counter()
    for i, text in TEXTS:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(low(x.strip(strip)), ())) >= 3 and key(i) < max(h))]
        want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    assert multiset(line_dedup.dedup_lines(docs), "doc_id", "n_lines", "n_dropped", "text") == want
    assert line_dedup.dedup_lines(empty).count() == 0


def test_hot_line_over_many_partitions(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(LINE + "\n"), "id").alias("text")).repartition(8)
    out = line_dedup.dedup_lines(df)
    assert out.where("n_dropped = 0").select("doc_id").collect() == [(2999,)] and out.agg(F.sum("n_dropped")).first()[0] == 2999


# simhash ---------------------------------------------------------------------------------------
def brute_fingerprint(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def test_simhash_components(docs, empty):
    prints = [(key(i), brute_fingerprint(t)) for i, t in TEXTS]
    label = {i: i for i, _ in prints}
    for _ in prints:
        for i, f in prints:
            for j, g in prints:
                if i == j or (f ^ g).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    back = lambda i: None if i == common.NULL_ID else i
    want = Counter((back(i), f"{f:016x}", back(label[i])) for i, f in prints)
    assert multiset(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0


def test_links_of_a_dense_group(spark):
    """A chain at distance 2, and a ball around one fingerprint: one component each, no pairs lost."""
    chain = [(1 << (2 * k)) - 1 for k in range(12)]
    ball = [0x5555555555555555 ^ (1 << b) for b in range(63)]
    far = [0x00FF00FF00FF00FF, 0x00FF00FF00FF00F8]
    df = spark.createDataFrame([(x,) for x in [*chain, *ball, *far]], "fp long")
    for blocks, dense in ((4, 64), (4, 2), (5, 3)):
        found = {r.node: r.component for r in common.components(simhash.hamming_links(df, blocks, dense)).collect()}
        assert {found[x] for x in chain} == {0} and len({found[x] for x in ball}) == 1 and not set(far) & set(found)


def test_rows_of_one_document(spark):
    """Rows of one doc_id with unlike texts have a component each."""
    one, two = (" ".join(f"{c}{random.randint(0, 10**6)}" for _ in range(50)) for c in "ab")
    df = spark.createDataFrame([(5, one), (18, one), (18, two)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()) == [(5, 5), (18, 5), (18, 18)]


def test_similar_groups(spark, docs, empty):
    words = [f"w{random.randint(0, 5000)}" for _ in range(400)]
    near = [(1, words), (2, words[:200] + ["changed"] + words[201:]), (3, [f"v{random.randint(0, 5000)}" for _ in range(400)]), (4, words), (5, [])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in near], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}
    got = simhash.similar_groups(docs).collect()
    assert len(got) == len(TEXTS) and {r.component_id for r in got if r.doc_id in (4, 5, 6, 19)} == {4}
    assert simhash.similar_groups(empty).count() == 0


def test_similar_groups_lose_no_link(spark):
    """Links at hardly more than 0.8, a group of many near copies and a shared passage, against brute force."""
    rng = random.Random(11)
    filler = lambda n: [f"f{rng.randint(0, 10**6)}" for _ in range(n)]
    table = []
    for _ in range(100):
        words = filler(rng.randint(180, 220))
        table += [words, words[: int(len(words) * 0.895) + 1] + filler(len(words) - int(len(words) * 0.895) - 1)]
    center, passage = filler(100), filler(30)
    for _ in range(60):
        copy = list(center)
        for at in rng.sample(range(100), rng.randint(1, 3)):
            copy[at] = f"e{rng.randint(0, 10**6)}"
        table.append(copy)
    table += [passage + filler(rng.randint(5, 40)) for _ in range(40)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in table]
    label = list(range(len(table)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]) and label[i] != label[j]:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(table)], "doc_id long, text string").repartition(4)
    for options in ({}, {"hot_from": 4, "part": 7, "star_rounds": 0}, {"hot_from": 4, "part": 7, "star_rounds": 2, "split_from": 10}):
        assert {r.doc_id: r.component_id for r in simhash.similar_groups(df, **options).collect()} == dict(enumerate(label)), options


def test_similar_groups_of_repeated_lines(spark):
    """Repeats of a line neither part documents of nearly equal shingle sets nor merge documents that differ."""
    rng = random.Random(12)
    filler = lambda n: [f"f{rng.randint(0, 10**6)}" for _ in range(n)]
    line, body = filler(13), filler(200)
    table = [(1, body + line * 2), (2, body + line * 100), (3, line * 101 + filler(80)), (4, line * 101 + filler(80))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in table], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_components_of_random_graphs(spark):
    for seed in range(3):
        rng = random.Random(seed)
        edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]
        label = {x: x for e in edges for x in e if e[0] != e[1]}
        for _ in range(60):
            for a, b in edges:
                if a != b:
                    label[a] = label[b] = min(label[a], label[b])
        got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == label


# search ----------------------------------------------------------------------------------------
def test_top_k_is_exact(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    vectors = [(i, (base[i % 6] + rng.normal(size=8) * 0.2).tolist()) for i in range(400)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(300)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 8), (2003, [0.5, 0.25]), (2050, []), (None, [1.0] * 8), (0, vectors[0][1])]
    vectors += [(2100, [1e300] * 8), (2101, [-1e300, 1e-300, 5.0]), (2150, [1.0, 70000.0]), (2151, [70000.0, -3e9]), (2200, [float("inf"), 1.0]), (2201, [1.7e308] * 8), (2250, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, "c") for i, v in vectors], "vec_id long, embedding array<double>, v string")
    clean = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            clean[i] = [*(math.floor(Fraction(x) * 256) for x in v), *[0] * (8 - len(v))]
    want = set()
    for q, v in clean.items():
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in clean.items() if i != q)[:5]
            want |= {(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(best)}
    got = mtree.top_k(df, k=5, every=50, sample=64, nodes=7)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == want
    assert mtree.top_k(df.limit(0)).count() == 0


def test_sort_keys_order_as_numbers():
    numbers = [0, 1, -1, 255, -256, 2**63, -(2**63), 10**40, -(10**40), 10**600, -(10**600)] + [random.randint(-(2**70), 2**70) for _ in range(200)]
    assert [n for _, n in sorted((mtree.sort_key(n), n) for n in numbers)] == sorted(numbers)
    assert all(int.from_bytes(mtree.sort_key(n)[5:], "big", signed=True) == n for n in numbers)


def test_search_skips_what_bounds_exclude():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 300
    v = np.floor(np.vstack([c + rng.normal(size=(100, 16)) * 4 for c in centres])) / 256
    top = float(((v * 2.0**-5) ** 2).sum(1).max())
    tree = mtree.Tree(16, 256, {0: top}, 0, {0: (list(range(0, 2000, 7)), v[::7])}, 20)
    lifted = tree.lift(v, 0)
    node = ((lifted[:, None] - tree.pivots[None]) ** 2).sum(2).argmin(1)
    searches = []
    for n in range(20):
        at = np.flatnonzero(node == n)
        own = lifted[at]
        distances = np.sqrt(((own - own[0]) ** 2).sum(1))
        searches.append(mtree.Search([{"node": n, "radius": distances.max(), "parent_distance": float(np.sqrt(((own[0] - tree.pivots[n]) ** 2).sum())), "centre": own[0].tobytes(), "ids": at.tobytes(), "rows": v[at].tobytes(), "distances": distances.tobytes()}], tree))
    for q in range(0, 2000, 97):
        found, floor = [], None
        for search in searches:
            found = mtree.best(found + search.top_k(q, v[q], 5, floor), 5)
            floor = found[-1][0] if len(found) == 5 else None
        every = np.rint((v * 256) @ (v[q] * 256)).astype(np.int64)
        every[q] = -(2**62)
        order = np.lexsort((np.arange(2000), -every))[:5]
        assert [i for _, i in found] == order.tolist()
    assert sum(s.scored for s in searches) < 0.6 * 2000 * len(range(0, 2000, 97))


# archives --------------------------------------------------------------------------------------
def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 80
    pages = [(3, "http://a\r\nX: y", big), (1, None, big), (1, "u", big), (2, "u", "tiny"), (4, "u", "tiny"), (5, "u", None), (None, "u", ""), (6, "u", "a\r\n\r\nWARC/1.1\r\nb" * 20)]
    df = spark.createDataFrame([(*p, "clash", 3) for p in pages], "page_id long, url string, html string, payload string, first int")
    for codec in ("gzip", "none"):
        path = f"file://{tmp_path}/{codec}"
        warc.write_warc(warc.with_records(df), path, file_bytes=400, compression=codec)
        back = warc.read_warc(spark, path)
        assert back.where("gap").count() == 0
        got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in back.collect())
        want = Counter()
        for i, _, html in pages:
            data = (html or "").encode()
            again = html == big and i == 3
            want[key(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None, b"" if again else data] += 1
        assert got == want
        assert len(list(tmp_path.glob(f"{codec}/part-*"))) > 2
    assert warc.with_records(df.limit(0)).count() == 0
    warc.write_warc(warc.with_records(df.limit(0)), f"file://{tmp_path}/empty")
    assert warc.read_warc(spark, f"file://{tmp_path}/empty").count() == 0


def record(n, body=b"payload"):
    digest = hashlib.sha256(body).hexdigest()
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha256:%s\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\n\r\n%s\r\n\r\n" % (n, digest.encode(), 19 + len(body), body)


def ids(found):
    return [warc._id(r["warc-record-id"]) if r else "gap" for _, _, r, _ in found]


def test_salvage():
    good = [record(i) for i in range(4)]
    assert ids(warc.salvage_plain(b"".join(good))) == [0, 1, 2, 3]
    broken = good[1].replace(b"payload", b"paXload")
    found = list(warc.salvage_plain(good[0] + broken + good[2]))
    assert ids(found) == [0, "gap", 2] and found[1][:2] == (len(good[0]), len(good[0]) + len(broken)) and found[1][3] == "wrong digest"
    assert ids(warc.salvage_plain(good[0] + good[1][:-30] + good[2])) == [0, "gap", 2]
    assert ids(warc.salvage_plain(b"junk" + good[0] + b"WARC/1.1\r\ncut")) == ["gap", 0, "gap"]
    members = [gzip.compress(g) for g in good]
    assert ids(warc.salvage_gzip(b"".join(members))) == [0, 1, 2, 3]
    bad = bytearray(members[1])
    bad[len(bad) // 2] ^= 255
    found = list(warc.salvage_gzip(members[0] + bytes(bad) + members[2]))
    assert [x for x in ids(found) if x != "gap"] == [0, 2] and "gap" in ids(found)
    whole = gzip.compress(b"".join(record(i, random.randbytes(3000)) for i in range(30)))
    kept = [x for x in ids(warc.salvage_gzip(whole[: len(whole) // 2])) if x != "gap"]
    assert kept == list(range(len(kept))) and 5 < len(kept) < 30
    assert list(warc.salvage_plain(b"")) == []


def test_salvage_of_written_archives(spark, tmp_path):
    """A damaged byte costs one record of a file that write_warc wrote, wherever it is."""
    rng = random.Random(8)
    df = spark.createDataFrame([(i, "u", "".join(rng.choices("abcdefgh é", k=600))) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(warc.with_records(df).coalesce(1), f"file://{tmp_path}/whole")
    (file,) = tmp_path.glob("whole/part-*")
    data = file.read_bytes()
    assert gzip.decompress(data).count(b"WARC/1.1") == 60
    for n, at in enumerate([0, len(data) // 2, len(data) - 60]):
        (tmp_path / f"hurt{n}").mkdir()
        (tmp_path / f"hurt{n}" / file.name).write_bytes(data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :])
        back = warc.read_warc(spark, f"file://{tmp_path}/hurt{n}").collect()
        assert len({r.page_id for r in back if not r.gap}) >= 59 and any(r.gap for r in back)


def test_salvage_before_damage_in_a_slice():
    good = [record(i, random.randbytes(300)) for i in range(40)]
    data = bytearray(gzip.compress(b"".join(good)))
    data[len(data) - 4000 : len(data) - 3980] = bytes(20)
    found = list(warc.salvage_gzip(bytes(data)))
    assert len(data) < 65536 and any(r is None for _, _, r, _ in found) and sum(r is not None for _, _, r, _ in found) > 20


# decontamination -------------------------------------------------------------------------------
def test_decontamination(spark, docs):
    filler = lambda n: " ".join(random.choice(WORDS) + str(random.randint(0, 99999)) for _ in range(n))
    items = [(1, filler(60)), (2, filler(18)), (3, "two words"), (4, None), (5, ""), (6, filler(60))]
    words = items[0][1].split()
    edge = " ".join(["edited", *words[1:]])
    middle = " ".join([*words[:30], "edited", *words[31:]])
    table = [(1, filler(50) + " " + items[0][1].upper().replace("É", "É") + "\n" + filler(40)), (2, items[1][1]), (3, filler(30) + " Two  words " + filler(9)), (4, filler(90)), (5, "x " + edge + " y"), (6, "x " + middle + " y"), (7, None), (None, items[1][1]), (8, items[5][1][:40])]
    df = spark.createDataFrame([(*r, 1) for r in table], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(*r, "c") for r in items], "item_id long, text string, similarity string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contamination(df, bench).collect()}
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    split = lambda s: re.findall(r"[^\x20\x09-\x0D]+", low(s))
    want = {}
    for i, text in table:
        for j, item in items:
            a, b = split(text), split(item)
            if not a or not b:
                continue
            width = min(5, len(b))
            grams = lambda w: Counter(tuple(w[k : k + width]) for k in range(len(w) - width + 1))  # noqa: E731, B023
            n = min(len(a), len(b))
            for s in range(len(a) - n + 1):
                x, y = grams(a[s : s + n]), grams(b)
                value = sum((x & y).values()) / max(1, sum((x | y).values()))
                if value >= 0.8:
                    want[i, j] = max(want.get((i, j), 0), value)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert (5, 1) in got and (6, 1) in got and (8, 6) not in got
    assert decontaminate.contamination(docs, bench.limit(0)).count() == 0 and decontaminate.contamination(df.limit(0), bench).count() == 0


def test_hamming_index_finds_all_within_radius():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**63, 300, dtype=np.uint64)
    index = decontaminate.HammingIndex(fps, 24)
    queries = np.array([int(fps[rng.integers(300)]) ^ sum(1 << int(b) for b in rng.choice(63, int(rng.integers(0, 30)), replace=False)) for _ in range(50)], np.uint64)
    want = {(q, i) for q, f in enumerate(queries.tolist()) for i, g in enumerate(fps.tolist()) if (f ^ g).bit_count() <= 24}
    assert set(zip(*(x.tolist() for x in index.within(queries)))) == want


def test_rolling_fingerprints():
    hashes = np.random.default_rng(3).integers(0, 2**63, 200, dtype=np.uint64)
    for inside in (1, 2, 33, 200):
        assert decontaminate.rolling_fingerprints(hashes, inside).tolist() == [simhash.simhash(hashes[i : i + inside]) for i in range(201 - inside)]


# toxicity --------------------------------------------------------------------------------------
def test_toxicity(spark, docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["la", "ro", "mi", "ten", "sa", "ku"]) for _ in range(rng.randint(1, 3)))
    bad = ["horrid", "vilefool", "despised"]
    table, marks = [], []
    for i in range(1200):
        toxic = i % 4 == 0
        text = [rng.choice(bad) if toxic and rng.random() < 0.06 else word() for _ in range(rng.randint(60, 160))]
        table.append((i, " ".join(text), "clash"))
        marks.append((i, int(toxic)))
    df = spark.createDataFrame(table, "doc_id long, text string, toxic string").repartition(4)
    labels = spark.createDataFrame([*marks, (None, 1), (5000, 1), (3, None), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(df, model).collect()}
    held = [(scores[i], t) for i, t in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == bool(t) for s, t in held) / len(held) > 0.9
    again = toxicity.toxicity_scores(docs, model).collect()
    assert len(again) == len(TEXTS) and all(0 <= r.score <= 1 for r in again)
    assert toxicity.fit(df, labels.where("toxic = 0")) is None
    assert {r.score for r in toxicity.toxicity_scores(docs, None).collect()} == {0.0}
    assert toxicity.toxicity_scores(docs.limit(0), model).count() == 0
    flags = {r[0]: r[1] for r in df.select("doc_id", toxicity.held_out(F.col("doc_id"))).collect()}
    assert all(flags[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(1200))


# registered queries ----------------------------------------------------------------------------
def test_queries_with_sql(spark):
    from tessera.llm import registry
    from tests.compare import SMALL

    con = connect()
    for name, sql in registry.ORACLES.items():
        assert rows(registry.QUERIES[name](spark, SMALL).toPandas()) == rows(con.sql(sql).df()), name


def test_queries_without_sql_are_whole(spark):
    from tessera.llm import registry
    from tests.compare import SMALL

    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name in set(registry.QUERIES) - set(registry.ORACLES) - {"op9_benchmark_decontamination"}:
        assert registry.QUERIES[name](spark, SMALL).select("doc_id").distinct().count() == n, name


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("gone", F.lit(1)).withColumn("hit", F.lit(2))
    columns, steps = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.keep(stage(spark, docs, folder), "stage")
        assert docs.columns == columns
        steps.append((before, docs))
    (_, tox), (_, lined), (_, single), (_, clean) = steps
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert tox.join(labels.where("toxic = 0"), "doc_id").count() >= 0.95 * steps[0][0].join(labels.where("toxic = 0"), "doc_id").count()
    assert lined.count() == tox.count() and lined.where(F.char_length("text") != F.col("n_chars")).count() == 0
    assert single.groupBy("text").count().where("count > 1").count() == 0
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert not any(i in r.text for r in clean.collect() for i in items)
    packed = corpus_pipeline.STAGES[-1][1](spark, clean, folder)
    assert packed.select("doc_id").distinct().count() == clean.count()
    assert corpus_pipeline.packing(spark, clean.limit(0), folder).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, steps[0][0].limit(0), folder).count() == 0
