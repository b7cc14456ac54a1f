"""Divergence of sources, the Merkle manifest and personal data against brute force, and word hashes that don't collide."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, divergence, manifest, pii, simhash, substring_dedup, textarrays

random.seed(11)
LONG = " ".join(random.choice(["alpha", "Beta", "été", "京都", "x1y"]) for _ in range(40_000))
ROWS = [
    *[(i, random.choice(["Alpha beta été", "beta Gamma-delta gamma", "Über 京都 x9 alpha", "one"]) + f" w{i % 3}x", random.choice(["en", "de", None]), random.choice(["a", "b", "c", None]), i) for i in range(60)],
    (60, None, "en", "a", 1), (61, "", "fr", "a", None), (62, "12 34 --", "fr", "b", 3), (62, "12 34 --", "fr", "b", 3), (62, "other TEXT", "fr", "b", 3), (None, "Null id", "en", "a", 4), (None, "Null id two", "en", "a", 4),
    (63, LONG, "en", "z", 5), (-5, "negative", "it", "a", 6), (2**62, "Large", "en", "b", 7), (64, "alone", "", "", 8),
]
CLASH = ["place", "n", "key", "value", "rank", "base", "spans", "pattern", "group", "leaf", "item"]


@pytest.fixture(scope="module")
def docs(spark):
    """Null ids, texts and languages, ties, repeated rows, a very long text, columns with clashing names."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


# divergence of sources ---------------------------------------------------------------------------
def brute_divergence(table, min_docs, top):
    texts = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source, _ in table]
    frequency, groups, out = Counter(), defaultdict(Counter), []
    for lang, source, terms in texts:
        frequency.update((lang, t) for t in set(terms))
        groups[lang, source].update(terms)
    for lang in {k[0] for k in groups}:
        kept = [t for (of, t), n in frequency.items() if of == lang and n >= min_docs]
        share = lambda counts, t, kept=kept: 1 + 10**9 * (counts[t] + 5) // (sum(counts[k] for k in kept) + 5 * len(kept))
        whole = sum((c for k, c in groups.items() if k[0] == lang), Counter())
        for (of, source), counts in groups.items():
            if of == lang:
                pairs = [(s, sum(abs(share(counts, t) - share(c, t)) for t in kept)) for (o, s), c in groups.items() if o == lang and s != source]
                terms = [(t, share(counts, t) - share(whole, t)) for t in kept if counts[t] and share(counts, t) > share(whole, t)]
                for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                    ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                    out += [(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(ordered, 1)]
    return Counter(out)


@pytest.mark.parametrize("min_docs", [1, 3, 500])
def test_divergence_is_brute_force(docs, min_docs):
    got = Counter(tuple(r) for r in divergence.divergence(docs, min_docs, 4).collect())
    assert got == brute_divergence(ROWS, min_docs, 4)


def test_divergence_of_nothing(docs):
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_sketch_never_underestimates(docs):
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    key = textarrays.fresh_key()
    table = divergence.sketch(rows, divergence.LEAST_CELLS, key)
    true = Counter()
    for _, text, lang, _, _ in ROWS:
        true.update({(lang or "", t) for t in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode().lower())})
    assert len(true) > 20
    for (lang, term), n in true.items():
        data = np.frombuffer(term, np.uint8)
        hashes = textarrays.word_hashes(data, np.array([0]), np.array([len(term)]), key)
        at = divergence._cells(divergence._of_lang(hashes, divergence._lang_hash(lang, key)), divergence.LEAST_CELLS)
        assert table[at].min() >= n


def test_shares_are_exact_for_large_counts(spark):
    n, total, v = 9_007_199_254_740_993, 2**62, 12345
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 5) // (total + 5 * v)


# Merkle manifest ---------------------------------------------------------------------------------
def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(doc_id, text, lang, source, n_chars):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def brute_tree(digests, fanout):
    """The root, and for each leaf the digests (left, right) of each level."""
    at, paths, level = list(range(len(digests))), [[] for _ in digests], list(digests)
    while len(level) > 1:
        for i, k in enumerate(at):
            run = k // fanout * fanout
            paths[i].append(("".join(level[run:k]), "".join(level[k + 1 : run + fanout])))
        level = [H(*level[k : k + fanout]) for k in range(0, len(level), fanout)]
        at = [k // fanout for k in at]
    return level[0], paths


def brute_manifest(table, fanout):
    by_lang, out = defaultdict(list), []
    for row in table:
        lowered = None if row[1] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[1])
        changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
        by_lang[row[2]].append((row[0], brute_leaf(*row), brute_leaf(row[0], lowered, *row[2:]) if changed else brute_leaf(*row)))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        by_lang[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(brute_tree([x[1] for x in by_lang[lang]], fanout))
    root, tops = brute_tree([t[0] for t in trees], fanout)
    for lang, (subroot, paths), top in zip(langs, trees, tops, strict=True):
        for (doc_id, leaf, given), path in zip(by_lang[lang], paths, strict=True):
            folded = given
            for left, right in path + top:
                folded = H(left, folded, right)
            out.append((doc_id, leaf, subroot, root, H(*(x for p in path + top for x in p)), folded))
    return Counter(out)


@pytest.mark.parametrize("fanout", [2, 8])
def test_manifest_is_brute_force(docs, fanout):
    found = manifest.manifest(docs, fanout)
    proof = F.sha2(F.concat_ws("", F.transform("path", lambda x: F.concat(x["l"], x["r"]))), 256)
    got = found.select("doc_id", "leaf", "subroot", "root", proof, manifest.folded(F.coalesce("tampered", "leaf"), F.col("path"))).collect()
    assert Counter(tuple(r) for r in got) == brute_manifest(ROWS, fanout)


@pytest.mark.parametrize("rows", [[], ROWS[:1], ROWS[60:61], [r for r in ROWS if r[2] == "en"][:20]])
def test_manifest_of_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = manifest.manifest(df)
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root) for r in got.collect()) == Counter(k[:4] for k in (brute_manifest(rows, 8) if rows else {}))


@pytest.mark.parametrize("bucket", [1, 3, 4096])
def test_radix_ranks_are_places(spark, bucket):
    table = [(g, k, random.randint(1, 3)) for g in ("a", "b", None) for k in {random.choice([0, 1, 5, 2**40]) * 7 + random.randint(-300, 300) for _ in range(50)} | {None}]
    df = spark.createDataFrame(table, "g string, id long, copies long").withColumn("key", manifest.id_key("id"))
    got = {(r.g, r.id): r.place for r in manifest.radix_ranks(df, "g", "key", "copies", bucket).collect()}
    below = lambda x, y: x is not None and (y is None or y < x)
    assert got == {(g, k): sum(c for h, j, c in table if h == g and j != k and below(k, j)) for g, k, _ in table}


# personal data -----------------------------------------------------------------------------------
def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0


def digits(v):
    return re.sub("[^0-9]", "", v)


BASE = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(digits(v)) <= 19 and luhn(digits(v))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(digits(v)) <= 15),
]


def brute_base(text):
    return sorted((m.start(), k, m.end()) for k, (form, fine) in enumerate(BASE) for m in re.finditer(form, text or "") if fine(m.group()))


AWKWARD = [
    "a@b.c_d@e.f g@@h.i x@y j@k-l.m.", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.0255 0001.2.3.4 9.9.9", "4111 1111 1111 1111 4111-1111-1111-1112 41111111  11111111",
    "+1 (555) 555-0100 +12 3 ++1234567890 +1------2345678901", "\x01a@b.cd\x01 1.1.1.1\x02", "😀 a@b.cd 😀😀 10.0.0.1", None, "", " \n\t", "a" * 30_000 + "@b.c " + "1" * 30_000 + " " + "+1" + " (" * 20_000,
    "1.1.1.1 " * 3_000 + "x@y.zz " * 3_000, "--++@@..", "4111111111111111" * 3, "+4111111111111111 me@4111111111111111.1.1.1.1",
]


def test_base_spans_are_brute_force(spark):
    rng = random.Random(3)
    texts = AWKWARD + ["".join(rng.choice("a1.@+- (") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.personal_data(df).select("doc_id", "base").collect()}
    assert got == {i: brute_base(t) for i, t in enumerate(texts)}


def brute_spans(table, rounds, least, support):
    """The bootstrapping in plain loops, for texts without punctuation round their words."""
    shaped = re.compile(pii.SHAPED)
    places, found, seeds = defaultdict(set), [], {}
    for doc, (_, text) in enumerate(table):
        at = [(m.start(), m.group()) for m in re.finditer(r"\S+", text or "")]
        words = [None, None, *(w.lower() for _, w in at), None, None]
        for i, (start, word) in enumerate(at):
            l2, l1, _, r1, r2 = words[i : i + 5]
            forms = [f"1:{l1}" if l1 else None, f"2:{l2} {l1}" if l2 and l1 else None, f"b:{l1} {r1}" if l1 and r1 else None, f"r:{r1} {r2}" if r1 and r2 else None]
            for p in filter(None, forms):
                places[p].add(word.lower() if not shaped.search(word) else None)
            if shaped.search(word) and 4 <= len(word) <= 64:
                kind = next((k for k, (form, fine) in enumerate(BASE) if (m := re.search(form, word)) and fine(m.group())), None)
                found.append((doc, start, start + len(word), word, kind, list(filter(None, forms))))
                seeds[word] = kind
    edges = {(p, v) for *_, v, _, forms in found for p in forms}
    of = defaultdict(set)
    for p, v in edges:
        of[p].add(v)
    score = {v: (1_000_000, 3 - k) for v, k in seeds.items() if k is not None}
    accepted = {}
    for _ in range(rounds):
        accepted = {}
        for p, values in of.items():
            known = [score.get(v, (0, None)) for v in values]
            if sum(s >= least * 1_000_000 for s, _ in known) >= support:
                confidence = 4 * sum(s for s, _ in known) // (sum(4 if s else 1 for s, _ in known) + 4 * len(places[p] - {None}))
                if confidence >= least * 1_000_000:
                    weight = Counter()
                    for s, order in known:
                        if order is not None:
                            weight[order] += s
                    accepted[p] = (confidence, max(weight, key=lambda o: (weight[o], o)))
        if not accepted:
            break
        score = {v: (1_000_000, 3 - k) for v, k in seeds.items() if k is not None}
        for p, value in accepted.items():
            for v in of[p]:
                if seeds[v] is None:
                    score[v] = max(score.get(v, (0, 0)), value)
    out = {i: brute_base(t) for i, (_, t) in enumerate(table)}
    for doc, start, end, _, kind, forms in found:
        hits = [accepted[p] for p in forms if p in accepted]
        if kind is None and hits and not any(a < end and b > start for a, _, b in brute_base(table[doc][1])):
            out[doc].append((start, 3 - max(hits)[1], end))
    return {i: sorted(s) for i, s in out.items()}


def test_patterns_are_brute_force(spark):
    rng = random.Random(4)
    table = []
    for i in range(300):
        words = [rng.choice(["the", "of", "and", "a", "house", "Green", "7up", "b_c", "x1"]) for _ in range(rng.randint(0, 12))]
        kind = rng.randint(0, 5)
        extra = [["write", "to", f"u{i}@ex.com"], ["write", "to", f"user_{i}"], ["host", f"10.0.{i % 250}.1", "port"], ["host", f"node{i}x", "port"], ["mail", f"user_{i - 5}", "soon"], []][kind]
        at = rng.randint(0, len(words))
        table.append((i, " ".join(words[:at] + extra + words[at:])))
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.personal_data(df).collect()}
    want = brute_spans(table, 3, 0.5, 3)
    assert got == want
    planted = [i for i, t in table if re.search(r"write to user_|host node", t)]
    assert planted and all(len(got[i]) > len(brute_base(table[i][1])) for i in planted)


def test_unseen_identifiers_of_several_words(spark):
    table = [(i, f"and call +1 (555) 555-1{i}0 soon, or mail to u{i}@ex.com now") for i in range(10, 16)]
    table += [(20, "and call 555 0188 99 soon, or mail to jane [at] ex [dot] com now"), (21, "and call home soon, or mail to (handle_7)! now"), (22, "the year 1999 2000"), (22, "the year 1999 2000")]
    df = spark.createDataFrame(table, "doc_id long, text string")
    found = defaultdict(list)
    for r in pii.personal_data(df).collect():
        found[r.doc_id].append([dict(table)[r.doc_id][s.start : s.end] for s in r.spans])
    assert found[20] == [["555 0188 99", "jane [at] ex [dot] com"]] and found[21] == [["handle_7"]] and found[22] == [[], []]
    # many patterns are joined by a shuffle instead of a broadcast
    patterns = spark.createDataFrame([("1:call",), ("2:mail to",), ("r:soon, or",)], "pattern string")
    counts = [{r.pattern: r.plain for r in pii.plain_words(df, patterns, few).collect()} for few in (0, 100)]
    assert counts[0] == counts[1] == {"1:call": 1, "2:mail to": 1, "r:soon, or": 1}


def test_personal_data_of_odd_tables(spark, docs):
    assert pii.personal_data(docs.limit(0)).count() == 0
    got = pii.personal_data(docs)
    assert got.columns == ["doc_id", "base", "spans"] and got.count() == len(ROWS)


# words that used to hash alike -------------------------------------------------------------------
def colliding_words():
    """Two words of sixteen letters that a chain of mixes, eight bytes a step, cannot tell apart."""
    rng, c = np.random.default_rng(1), np.uint64(0x9E3779B97F4A7C15)
    start = np.uint64(16) * c
    while True:
        a = rng.integers(97, 123, (4096, 2, 8), dtype=np.uint8)
        first = a.view("<u8").reshape(-1, 2)
        apart = (textarrays.mix(start ^ first[:, 0]) ^ textarrays.mix(start ^ first[:, 1])).view(np.uint8).reshape(-1, 8)
        for pair, d in zip(a, apart, strict=True):
            tails = [[x for x in range(33, 127) if 33 <= x ^ int(b) < 127] for b in d.tolist()]
            if all(tails):
                tail = bytes(t[0] for t in tails)
                other = bytes(t[0] ^ int(b) for t, b in zip(tails, d.tolist(), strict=True))
                return bytes(pair[0]).decode() + tail.decode(), bytes(pair[1]).decode() + other.decode()


def test_words_made_to_collide(spark):
    one, two = colliding_words()
    chain = lambda w: textarrays.mix(textarrays.mix(np.uint64(16) * np.uint64(0x9E3779B97F4A7C15) ^ np.frombuffer(w, "<u8")[:1]) ^ np.frombuffer(w, "<u8")[1:])
    assert one != two and chain(one.encode()) == chain(two.encode())
    rest = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup_words(df).collect()} == {1: 0, 2: 0, 3: 13}
    items = spark.createDataFrame([(7, one)], "item_id long, text string")
    words = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.contamination(words, items).collect()] == [1]
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(words).collect()} == {1: 1, 2: 2}


def test_short_words_never_hash_alike():
    words = sorted({bytes(random.randint(33, 126) for _ in range(n)) for n in range(1, 8) for _ in range(3000)})
    ends = np.cumsum([len(w) for w in words])
    for key in (0, textarrays.fresh_key()):
        hashes = textarrays.word_hashes(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends, key)
        assert len(set(hashes.tolist())) == len(words)


@pytest.mark.parametrize("bits", [2, 64])
def test_sets_of_one_name_stay_apart(spark, bits):
    """With names of two bits most sets clash, and their second hashes tell them apart."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrst") + str(rng.randint(0, 40)) for _ in range(30)) for _ in range(30)]
    df = spark.createDataFrame([(i, texts[i % 30]) for i in range(60)] + [(100, texts[3] + " tail")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df, name_bits=bits).collect()}
    assert got == {**{i: i % 30 for i in range(60)}, 100: 3}


def test_stages_pass_on_columns_of_any_name(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    names = ["score", "keep_0", "keep_1", "n_lines", "n_dropped", "bitmap", "text_hash", "component_id", "node", "item_id", "similarity", "gone", "hit"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, "en", "s", None), (None, "", "en", "s", 0), (3, "again", "en", "s", 5), (3, "again", "en", "s", 5), (900, "word " * 60_000, "en", "s", 300_000)], docs.schema)
    docs = common.keep(docs.unionByName(odd).withColumns({n: F.lit(f"as {n}") for n in names}), "odd")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.keep(stage(spark, docs, folder), "stage")
        assert out.columns == docs.columns, name
        assert all(out.where(f"{n} <> 'as {n}'").isEmpty() for n in names), name
        assert out.where("doc_id IS NULL").count() >= 1 and out.where("doc_id = 900").count() == 1, name
    assert corpus_pipeline.packing(spark, docs, folder).where("doc_id = 900").count() > 1


def test_toxicity_of_labelled_documents_held_out(spark):
    """A floor for what the method finds on the tables themselves; none of these documents was learnt from."""
    from tessera.llm import registry

    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = registry.QUERIES["op4_toxicity"](spark, folder).where("held_out").join(labels, "doc_id").where("toxic IS NOT NULL").collect()
    toxic, clean = ([r.score for r in rows if r.toxic == t] for t in (1, 0))
    wins = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert len(rows) >= 50 and wins > 0.85
    assert sum(s >= 0.5 for s in toxic) / len(toxic) >= 0.5 and sum(s < 0.5 for s in clean) / len(clean) >= 0.95
