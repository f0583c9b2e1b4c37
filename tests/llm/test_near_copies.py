"""The near-copy stage: five-word shingles, similarity 0.8, rows told apart by a key of their own."""

import random

import numpy as np

from laminar.llm import shingles, simhash


def plain_set(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return {b" ".join(words[a : a + k]) for a in range(len(words) - k + 1)} if words else set()


def plain_roots(texts):
    """Smallest index reachable, by comparing all pairs."""
    sets = [plain_set(t) for t in texts]
    root = list(range(len(texts)))

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or a and len(a & b) / len(a | b) >= 0.8:
                x, y = of(i), of(j)
                root[max(x, y)] = min(x, y)
    return [of(i) for i in range(len(texts))]


def random_words(rnd, n):
    return ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(n)]


def edited(rnd, words, edits):
    out = list(words)
    for at in rnd.sample(range(len(out)), edits):
        out[at] = random_words(rnd, 1)[0]
    return out


def test_near_copies_at_four_fifths(spark):
    rnd = random.Random(4)
    texts = []
    for n, edits in ((100, 1), (100, 2), (200, 4), (500, 10), (100, 8)):  # the last ones are below 0.8
        for _ in range(20):
            words = random_words(rnd, n)
            texts += [" ".join(words), " ".join(edited(rnd, words, edits)).upper()]
    want = sorted(set(plain_roots(texts)))
    assert 80 <= len(texts) - len(want) < 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in shingles.representatives(docs).collect()) == want


def test_large_group_and_chains_of_near_copies(spark):
    rnd = random.Random(5)
    base = random_words(rnd, 120)
    texts = [" ".join(edited(rnd, base, rnd.randint(0, 3))) for _ in range(300)]
    for _ in range(4):  # chains: neighbours are similar, ends aren't
        words = random_words(rnd, 150)
        for _ in range(40):
            texts.append(" ".join(words))
            words = edited(rnd, words, 2)
    rnd.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in shingles.representatives(docs).collect()) == sorted(set(plain_roots(texts)))


def families(rnd, size):
    """Edited copies of one base: most pairs are about as similar as the threshold asks."""
    base = random_words(rnd, 400)
    return [" ".join(edited(rnd, base, rnd.randint(5, 6))) for _ in range(size)]


def fast_roots(texts):
    """As plain_roots, by counting shared shingles from an index of shingles."""
    from collections import Counter, defaultdict

    sets, index, root = [plain_set(t) for t in texts], defaultdict(list), list(range(len(texts)))

    def of(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in index[x]).items():
            if n / (len(s) + len(sets[j]) - n) >= 0.8:
                x, y = of(i), of(j)
                root[max(x, y)] = min(x, y)
        for x in s:
            index[x].append(i)
    return [of(i) for i in range(len(texts))]


def test_dense_families_at_the_threshold(spark):
    rnd = random.Random(11)
    texts = [t for _ in range(3) for t in families(rnd, 400)]
    rnd.shuffle(texts)
    want = sorted(set(fast_roots(texts)))
    assert 50 < len(want) < 1100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in shingles.representatives(docs).collect()) == want


def test_tiles_of_many_blocks_and_columns(spark, monkeypatch):
    for name, value in (("BLOCK_WEIGHT", 20_000), ("COLUMNS", 64)):
        monkeypatch.setattr(shingles, name, value)
    rnd = random.Random(12)
    texts = families(rnd, 300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in shingles.representatives(docs).collect()) == sorted(set(fast_roots(texts)))


def test_columns_of_any_name(spark):
    rnd = random.Random(13)
    rows = [(k, " ".join(random_words(rnd, 30))) for k in range(3)]
    rows.append((3, rows[0][1]))
    names = ["__set", "__row", "__size", "__bands", "__minima", "__fp", "__digest", "best", "label", "n", "c0", "first", "stays"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], ["doc_id", "text", *names])
    got = shingles.representatives(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.filter("doc_id < 3").collect()))


def test_near_copies_of_a_table(docs):
    rows = sorted(docs.select("doc_id", "text").collect())
    want = sorted(rows[k][0] for k in set(plain_roots([t for _, t in rows])))
    assert sorted(r["doc_id"] for r in shingles.representatives(docs).collect()) == want


def test_null_and_repeated_ids_cost_no_other_row(spark):
    rnd = random.Random(6)
    a, b, c, d, e = (" ".join(random_words(rnd, 30)) for _ in range(5))
    rows = [(3, a), (None, a), (None, b), (None, c), (None, c), (7, a), (7, d), (9, e), (9, e.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["text"].lower()) for r in shingles.representatives(docs).collect()), key=repr)
    assert got == sorted([(3, a), (None, b), (None, c), (7, d), (9, e)], key=repr)
    assert shingles.representatives(docs.limit(0)).count() == 0


def test_segments_give_the_first_candidates(spark, monkeypatch):
    """Without any MinHash key, near copies whose fingerprints differ in few bits are found by their segments."""
    rnd = random.Random(14)
    texts = []
    for _ in range(40):
        words = random_words(rnd, 400)
        texts += [" ".join(words), " ".join(edited(rnd, words, 1))]
    prints = [simhash.majority(shingles.shingle_set(t.encode())) for t in texts]
    close = [(prints[k] ^ prints[k + 1]).bit_count() <= simhash.BITS for k in range(0, len(texts), 2)]
    assert 10 < sum(close) < 40
    filed = shingles.filed
    monkeypatch.setattr(shingles, "filed", lambda sets: filed(sets.limit(0)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = [k for k in range(len(texts)) if k % 2 == 0 or not close[k // 2]]
    assert sorted(r["doc_id"] for r in shingles.representatives(docs).collect()) == want


def test_a_forest_connects_what_all_edges_do():
    r = np.random.default_rng(15)
    for n in range(1, 60):
        left, right = (r.integers(0, n, 2 * n) for _ in "ab")
        kept = simhash.forest(n, left, right)
        assert list(simhash.roots(n, left[kept], right[kept])) == list(simhash.roots(n, left, right)) and len(kept) < n
