"""Operators on whole tables against plain Python versions."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from laminar.llm import mixing, simhash, warc

from .test_near_copies import plain_roots

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = WORD.findall(low)
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """Smallest index reachable, by comparing all pairs."""
    distinct = sorted(set(prints))
    label = {f: f for f in distinct}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {f: root(f) for f in distinct}


def check_components(rows):
    prints = [(r["doc_id"], int(r["fingerprint"], 16)) for r in rows]
    root = plain_components([f for _, f in prints])
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    for r in rows:
        assert r["component_id"] == least.get(root[int(r["fingerprint"], 16)])


def test_near_duplicates(docs, odd_docs):
    for df in (docs, odd_docs):
        rows = simhash.near_duplicates(df).collect()
        want = sorted(((r["doc_id"], f"{plain_fingerprint(r['text'] or ''):016x}") for r in df.select("doc_id", "text").collect()), key=repr)
        assert sorted(((r["doc_id"], r["fingerprint"]) for r in rows), key=repr) == want
        check_components(rows)
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0


def cloud(rnd, n, flips):
    """Fingerprints in chains and balls around a few centres, and others."""
    out = []
    for _ in range(6):
        at = rnd.getrandbits(64)
        for _ in range(n):
            x = at
            for _ in range(rnd.randint(0, flips)):
                x ^= 1 << rnd.randrange(64)
            out.append(x)
            if rnd.random() < 0.1:
                at = x
    return out + [rnd.getrandbits(64) for _ in range(n)]


def test_links_of_fingerprints(spark):
    rnd = random.Random(8)
    prints = cloud(rnd, 120, 3)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(k, f) for k, f in enumerate(signed)], "doc_id long, fp long")
    check_components(simhash.with_components(df, simhash.linked(df), "doc_id").collect())


def test_pigeonring_passes_all_links():
    rnd = random.Random(9)
    x = [sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))) for _ in range(5000)]
    assert simhash.pigeonring(np.array(x, np.uint64)).all()
    far = np.array([rnd.getrandbits(64) for _ in range(2000)], np.uint64)
    assert simhash.pigeonring(far).mean() < 0.01


def test_hot_keys_are_cut_up(spark, monkeypatch):
    """Members of one key, more than HOT: the same links, and no task meets them all."""
    rnd = random.Random(10)
    base = rnd.getrandbits(64)
    members = sorted({base ^ sum(1 << b for b in rnd.sample(range(28), rnd.randint(0, 9))) for _ in range(900)})
    monkeypatch.setattr(simhash, "HOT", 60)
    signed = np.array(members, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    sizes = [r["count"] for r in simhash.keyed(df.select("fp")).groupBy("k", "part").count().collect()]
    assert max(sizes) < len(members) / 3
    check_components(simhash.with_components(df, simhash.linked(df), "doc_id").collect())


def test_hot_keys_are_cut_up_until_they_are_small(spark, monkeypatch):
    """Members that agree in all but twenty bits: keys of the second choice are hot as well."""
    rnd = random.Random(11)
    base = rnd.getrandbits(64)
    members = sorted({base ^ rnd.getrandbits(10) << 40 ^ rnd.getrandbits(10) for _ in range(2500)})
    monkeypatch.setattr(simhash, "HOT", 40)
    df = spark.createDataFrame(list(enumerate(np.array(members, np.uint64).view(np.int64).tolist())), "doc_id long, fp long")
    keys = simhash.keyed(df.select("fp")).groupBy("k", "part").count().collect()
    bits = [((r["k"] & (1 << 64) - 1).bit_count(), r["count"]) for r in keys]
    assert all(n <= 40 or b >= 55 and n <= 512 for b, n in bits) and any(b >= 55 for b, _ in bits)
    check_components(simhash.with_components(df, simhash.linked(df), "doc_id").collect())


def test_finer_masks_meet_all_pairs():
    rnd = random.Random(14)
    for mask in simhash.key_masks():
        finer = simhash.finer_masks(mask)
        assert all(m & mask == mask and m.bit_count() >= 46 for m in finer)
        free = [b for b in range(64) if not mask >> b & 1]
        for _ in range(200):
            x = simhash.mask_of(rnd.sample(free, 3))
            assert any(not x & m for m in finer)


def test_representatives(odd_docs):
    rows = simhash.representatives(odd_docs).collect()
    assert [r["text"] for r in rows].count("one") == 1 and len({r["doc_id"] for r in rows}) == len(rows)
    assert set(rows[0].asDict()) == set(odd_docs.columns)


def test_warc(spark):
    rnd = random.Random(1)
    same = "<p>copy</p>"
    rows = [(k, f"http://{rnd.choice(['a', 'b', 'www.c'])}.example.com/x/{rnd.randint(0, 20)}?b=2&a=1#f", rnd.choice([same, "", None, f"<p>{k} WARC/1.1\r\n\r\n é</p>"])) for k in range(3000)]
    rows += [(3000, None, same), (3001, "http://[bad", "x"), (3002, "http://e.com/a\r\nb", "y" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "'z' AS payload").repartition(4)
    index = warc.capture_histories(pages)
    got = {r["page_id"]: r for r in index.collect()}
    assert len(got) == len(rows) == index.count()
    first = {}
    for i, _, html in rows:
        first[html or ""] = max(first.get(html or "", -1), i)
    for i, url, html in rows:
        raw, r = (html or "").encode(), got[i]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[html or ""] == i else ("revisit", first[html or ""]))
    parts = index.rdd.glom().collect()
    keys = [(r["url_key"].encode(), r["date"], r["page_id"]) for p in parts for r in p]
    assert keys == sorted(keys) and sum(1 for p in parts if p) > 1
    assert warc.capture_histories(pages.limit(0)).count() == 0


def test_warc_null_ids_and_repeated_rows(spark):
    rows = [(None, "http://a.com/1", "shared"), (7, "http://a.com/2", "shared"), (5, "http://a.com/3", "shared"), (None, None, "alone"), (None, "http://a.com/4", "alone"), (9, "http://a.com/5", "once"), (9, "http://a.com/5", "once")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.capture_histories(pages).collect()), key=repr)
    assert got == sorted([(None, "revisit", 7, 6), (7, "response", None, 6), (5, "revisit", 7, 6), (None, "response", None, 5), (None, "response", None, 5), (9, "response", None, 4), (9, "response", None, 4)], key=repr)


def test_archives_are_bounded_and_records_read_from_their_offsets(spark, tmp_path, monkeypatch):
    import gzip

    rnd = random.Random(3)
    rows = [(k, f"http://x.org/{k % 9}", rnd.randbytes(rnd.choice([10, 3000, 40_000])).hex()) for k in range(400)]
    monkeypatch.setattr(warc, "BLOCKS", 1)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path)
    files = {f.name: f.read_bytes() for f in (tmp_path / "archives").glob("*.txt")}
    assert len(files) > 2 and max(map(len, files.values())) <= warc.BLOCK_BYTES + 100
    whole = b"".join(gzip.decompress(d) for d in files.values())
    assert whole.count(b"WARC/1.1\r\n") == len(rows)
    html = {k: h for k, _, h in rows}
    for e in warc.index_runs(path, spark).collect():
        one = gzip.decompress(files[e["archive"]][e["offset"] : e["offset"] + e["length"]])
        assert one.count(b"WARC/1.1\r\n") == 1 and one.endswith(html[int(e["id"])].encode() + b"\r\n\r\n")


def test_merge_is_the_same_over_any_partitions(spark):
    rnd = random.Random(2)
    rows = [(k, "http://hot.org/" if k % 3 else f"http://h{rnd.randint(0, 40)}.org/", "x") for k in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    from laminar.llm.common import fresh_path

    path = fresh_path(spark, "warc-test")
    warc.write_archives(pages, path)
    runs = warc.index_runs(path, spark)
    one, four, many = (list(map(tuple, warc.merged_index(runs, n).collect())) for n in (1, 4, 33))
    assert one == four == many and max(r[-1] for r in one) == 2000


def test_runs_on_disk(monkeypatch):
    monkeypatch.setattr(warc, "RUN_ROWS", 50)
    monkeypatch.setattr(warc, "FAN_IN", 3)
    rnd = random.Random(9)
    every = [(rnd.choice("abc"), "2024", str(rnd.randint(0, 99)), 1, "d", "response", None, f"f{rnd.randint(0, 5)}", k, 1) for k in range(2345)]
    for n in (0, 1, 49, 50, 51, 2345):
        runs = warc.Runs()
        for e in every[:n]:
            runs.add(e)
        assert list(runs.merged()) == sorted(every[:n], key=warc.order_of)


def test_loser_tree():
    rnd = random.Random(6)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rnd.randint(0, 9), n) for n in range(rnd.randint(0, 8))) for _ in range(k)]
        assert list(warc.loser_tree([[(x, x) for x in r] for r in runs])) == sorted(x for r in runs for x in r)


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def check_mix(df, rows):
    sizes, taken, source = {}, {}, {}
    for r in df.collect():
        n = len(WORD.findall(r["text"] or ""))
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        source.setdefault((r["doc_id"], n), []).append(r["source"])
    want = plain_targets(sizes)
    longest = {}
    for r in rows:
        s = source[r["doc_id"], r["size"]].pop()
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-6)
        assert r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        longest[s] = max(longest.get(s, 0), r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s]


def test_mixing(docs, odd_docs):
    rows = mixing.mix(docs).collect()
    check_mix(docs, rows)
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(5)).collect())
    check_mix(odd_docs.filter("doc_id is not null and doc_id <> 7"), mixing.mix(odd_docs.filter("doc_id is not null and doc_id <> 7")).collect())
    assert mixing.mix(odd_docs).count() == odd_docs.count() and mixing.mix(odd_docs.limit(0)).count() == 0


def test_mixing_refuses_weights_and_caps_without_sense(docs):
    for kwargs in ({"weights": ()}, {"weights": (1, 0)}, {"cap": 0}, {"cap": -1}):
        with pytest.raises(ValueError):
            mixing.mix(docs, **kwargs)
    free = mixing.mix(docs, cap=1e12).groupBy("source_size", "target").count().collect()
    assert math.isclose(sum(r["target"] for r in free), sum(r["source_size"] for r in free), rel_tol=1e-9)


def test_key_bins_are_even_for_any_weight(spark):
    from pyspark.sql import functions as F

    for weight in (0.1, 1.0, 1e-4):
        keys = spark.range(100_000).select(mixing.sample_key("id", F.lit(weight), 1).alias("__key"))
        assert keys.groupBy(mixing.key_bin()).count().agg(F.max("count")).first()[0] < 300


def test_mixed_rows_follow_the_plan(docs):
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs).collect() if r["size"]}
    got = {r["doc_id"]: r["count"] for r in mixing.resample(docs).groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in want.items() if n}


def test_pipeline(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [docs]
    for _, stage in p.STAGES[:-1]:
        steps.append(spark.createDataFrame(stage(spark, steps[-1], sf).collect(), docs.schema))
        assert steps[-1].columns == docs.columns
    passed, single, redacted, mixed = steps[1:]
    assert 0 < passed.count() < docs.count()
    rows = sorted(passed.select("doc_id", "text").collect())
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(rows[k][0] for k in set(plain_roots([t for _, t in rows])))
    assert sorted(r["doc_id"] for r in redacted.collect()) == sorted(r["doc_id"] for r in single.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in redacted.collect())
    tokens = p.STAGES[-1][1](spark, mixed, sf)
    assert tokens.count() > 0 and {r["doc_id"] for r in tokens.select("doc_id").collect()} == {r["doc_id"] for r in mixed.collect()}
    assert p.run(spark, sf).count() > 0


#: Names that mixing and judging give to columns of their own.
OWN_NAMES = ["target", "source_size", "edge", "budget", "epochs", "cut", "bin", "ahead", "before", "words", "__times", "__source", "__id", "__size", "__key", "__copy", "__weight", "c0", "n_words", "kept", "content_share", "base_failed"]


def test_columns_of_any_name_stay_as_they_are(spark, docs, labels):
    from laminar.llm import linecrf

    extra = docs.withColumns({c: F.lit(f"{c}!") for c in OWN_NAMES})
    model = linecrf.fit(docs, labels)
    for keep in (mixing.resample, lambda d: linecrf.passing(d, model)):
        plain, made = keep(docs), keep(extra)
        assert made.columns == extra.columns
        assert sorted(r["doc_id"] for r in made.collect()) == sorted(r["doc_id"] for r in plain.collect())
        assert made.select(*OWN_NAMES).distinct().collect() == [tuple(f"{c}!" for c in OWN_NAMES)]
    heavy = mixing.resample(extra, weight=F.length("text").cast("double"))
    assert heavy.columns == extra.columns and heavy.count() > 0
