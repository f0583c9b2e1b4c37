"""Operators on single texts against plain Python versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from laminar.llm import linecrf, ogg, packing, pii, secretscan, tokencount, zstdquality

from .conftest import TOKEN

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture(params=["odd", "table", "empty"])
def texts(request, odd_docs, docs):
    return {"odd": odd_docs, "table": docs, "empty": odd_docs.limit(0)}[request.param]


def expected(df, one):
    return sorted(((r["doc_id"], *one(r["text"] or "")) for r in df.select("doc_id", "text").collect()), key=repr)


def test_token_counts(texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def one(t):
        n = len(library.encode(t, add_special_tokens=False).ids)
        return len(t.encode()), n, n > 1024

    got = tokencount.count_tokens(texts, public_tokenizers.path("byte_bpe_50k.json"))
    assert pairs(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == expected(texts, one)


def test_token_counts_of_strange_texts():
    import random

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(5)
    letters = "aabcdeehilmnorstuv'  \n\t.!#é漢 　 12９’\x1c\x85​ꟋJ"
    every = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    every += ["".join(chr(rnd.choice([rnd.randint(0, 0x2FF), rnd.randint(0, 0xD7FF), rnd.randint(0xE000, 0x10FFFF)])) for _ in range(30)) for _ in range(1000)]
    every += ["a" * 3000, "ab" * 900, "!" * 999, "'r", "'re", " " * 3000 + "x"]
    counter = tokencount.TokenCounter(public_tokenizers.path("byte_bpe_50k.json"), tokencount.char_classes())
    assert counter.counts(every) == [len(e.ids) for e in library.encode_batch(every, add_special_tokens=False)]


def test_compiled_states_stay_bounded_within_a_piece(monkeypatch):
    import random

    monkeypatch.setattr(tokencount, "MOST_STATES", 2000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter = tokencount.TokenCounter(path, tokencount.char_classes())
    rnd = random.Random(6)
    long = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    assert counter.counts([long]) == [len(Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids)]
    assert len(counter.machine.states) <= 2001 and len(counter.machine.stable) <= 40 * 2001


def test_piece_counts_of_composed_maps():
    """The pieces that the composed chunk maps count are those that the marks place, for any chunk borders."""
    import random

    rnd = random.Random(13)
    table = tokencount.char_classes()
    for n in (1, 5, 1023, 1024, 1025, 9000):
        text = "".join(rnd.choice("aabs' \n!9'rel  ") for _ in range(n)) + "\0"
        classes = table[np.frombuffer(text.encode("utf-32-le"), np.uint32)].copy()
        classes[-1] = tokencount.END
        tokencount.piece_starts(classes)  # fails where the counts differ from the marks


def rule_secrets(t):
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    spans.sort()
    text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
    return (*(sum(k == x for _, k, _ in spans) for x in range(3)), hashlib.sha256(text.encode()).hexdigest())


def test_secrets_base(texts):
    got = secretscan.find_secrets(texts)
    assert pairs(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == expected(texts, rule_secrets)
    for r in got.collect():
        base = [s for s in r["spans"].split(",") if s and not s.startswith("random")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]


def test_random_tokens_found_and_clean_texts_left(spark, docs):
    import base64
    import random

    rnd = random.Random(3)
    coded = [base64.b64encode(rnd.randbytes(30)).decode() for _ in range(40)]
    planted = spark.createDataFrame([(10**6 + k, f"look at {c} now and again") for k, c in enumerate(coded)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secretscan.find_secrets(docs.select("doc_id", "text").union(planted)).collect()}
    assert sum("random:8:48" in got[10**6 + k]["spans"] for k in range(40)) >= 36
    base_free = [r for i, r in got.items() if i < 10**6]
    assert sum("random" in r["spans"] for r in base_free) <= 0.02 * len(base_free)


def test_redaction(odd_docs):
    got = {r["doc_id"]: r for r in secretscan.redact(odd_docs).collect()}
    assert got[0]["text"] is None and got[1]["text"] == ""
    assert got[5]["text"] == '[SECRET]" and [SECRET] [SECRET] x'.replace('[SECRET]"', '[SECRET]"')
    assert set(got[5].asDict()) == set(odd_docs.columns)


def test_scores_tell_random_from_words():
    import random

    rnd = random.Random(1)
    coded = sorted(secretscan.score("".join(rnd.choices(secretscan.ENCODINGS["base62"], k=32))) for _ in range(200))
    assert coded[100] < 7 < secretscan.score("internationalization2and3more") and secretscan.score("aaaaaaaaaaaabbbbbbbbbbbb11") > secretscan.LARGEST


def rule_personal(t):
    spans = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    spans += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p[:4000]) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            spans.append((2, m.start(), m.end()))
    spans += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    spans.sort()
    text = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for k, a, b in spans)
    return (*(sum(k == x for k, _, _ in spans) for x in range(4)), hashlib.sha256(text.encode()).hexdigest())


def test_personal_data_base(texts):
    got = pii.find_personal_data(texts)
    assert pairs(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == expected(texts, rule_personal)


def test_personal_data_rules_on_strange_texts(spark):
    import random

    rnd = random.Random(11)
    rows = [(k, "".join(rnd.choice("a1@.-+ ()é%34567890 \n") for _ in range(rnd.randint(0, 80)))) for k in range(4000)]
    rows += [(5000 + k, "".join(rnd.choice("0123456789 -.") for _ in range(60))) for k in range(1500)]
    rows += [(7000 + k, "".join(rnd.choice("ab.@-") for _ in range(40))) for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert pairs(pii.find_personal_data(df), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == expected(df, rule_personal)


def test_contexts_find_unseen_identifiers(spark):
    rows = [(k, f"please call me on +1 (743) 555-{1000 + k} soon") for k in range(30)] + [(100, "please call me on ext-77123x soon"), (101, "there are 12345 words")]
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "context:18:28" and got[101] == "" and got[3].startswith("phone:18:")


def test_discovered_identifiers_support_further_patterns(spark):
    """Rule matches trust one pattern; what it discovers trusts a second one, which no rule match ever meets."""
    rows = [(k, f"please call me on +1 (743) 555-{1000 + k} today") for k in range(90)]
    rows += [(1000 + k, f"kindly call me on desk-77{100 + k}x today") for k in range(8)]
    rows += [(2000 + k, f"their direct line desk-77{100 + k}x works") for k in range(8)] + [(3000, "their direct line desk-99999z works"), (3001, "about 12345 words were read")]
    rows += [(4000, "nothing before\nid-5512y today")]
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1003] == "context:18:29" and got[2003] == "context:18:29" and got[3000] == "context:18:29" and got[3001] == ""


def test_context_spans_keep_off_rule_matches(spark):
    """Long blanks and URLs before an instance; discovered instances that hold a rule match stay the rule's."""
    far = "see https://example.org/" + "a" * 300 + " and" + " " * 200
    rows = [(k, f"id 10.0.0.{k} is open, {far}my account no AB{k:05d}C") for k in range(30)]
    rows += [(100 + k, f"my account no user{k}@mail.example is open") for k in range(300)]
    rows += [(500 + k, f"my account no x=10.0.{k}.1,z") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.find_personal_data(df).collect():
        spans = [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s]
        base = [s for s in spans if s[0] != "context"]
        assert all(a >= e or b <= s for k, a, b in spans if k == "context" for _, s, e in base)
        if r["doc_id"] < 30:
            text = dict(rows)[r["doc_id"]]
            at = text.index("AB")
            assert ("context", at, at + 8) in spans


def test_personal_data_time_is_linear_in_matches(spark):
    import time

    text = " ".join(f"{k}7" for k in range(150_000))
    df = spark.createDataFrame([(1, text), (2, "9.9.9.9 " * 20_000)], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in pii.find_personal_data(df).collect()}
    assert len(text) > 900_000 and time.time() - began < 60 and got[2]["n_ip"] == 20_000


def test_running_sums_by_block(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, pii.BLOCK - 1, pii.BLOCK, pii.BLOCK + 1, 3 * pii.BLOCK + 7):
        parts = ["x" * (k % 5) for k in range(n)]
        got = spark.createDataFrame([(parts,)], "p array<string>").select(pii.starts(F.col("p"))).first()[0]
        assert got == [sum(map(len, parts[:k])) for k in range(n)]


def rule_quality(t):
    words = BLANKS.findall(t)
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    met, hit = {}, set()
    for g in grams:
        met[g] = met.get(g, 0) + 1
    for k, g in enumerate(grams):
        if met[g] > 1:
            hit.update(range(k, k + 8))
    real = [x for x in t.split("\n") if BLANKS.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(real) - len(set(real)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_quality_base(texts, labels, docs):
    model = linecrf.fit(docs, labels)
    got = linecrf.judge(texts, model)
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert pairs(got, "doc_id", *cols) == expected(texts, rule_quality)
    assert got.filter("base_failed and kept").isEmpty()


def test_viterbi_is_the_best_path():
    import itertools
    import random

    import numpy as np

    rnd = random.Random(2)
    for _ in range(200):
        scores, moves = [rnd.gauss(0, 1) for _ in range(rnd.randint(1, 7))], np.array([[rnd.gauss(0, 1) for _ in "ab"] for _ in "ab"])
        value = lambda path: sum(s for s, y in zip(scores, path) if y) + sum(moves[a][b] for a, b in itertools.pairwise(path))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=len(scores)), key=value)
        assert tuple(linecrf.viterbi(scores, moves)) == best


def test_good_documents_stay(spark):
    """On labels that the field hasn't learnt from."""
    big = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    got = linecrf.judge(docs, linecrf.fit(docs, labels, keep=~zstdquality.held_out("doc_id"))).join(labels, "doc_id").filter(zstdquality.held_out("doc_id"))
    share = {r["quality"]: r["s"] for r in got.filter("n_words >= 20").groupBy("quality").agg({"kept": "max"}).withColumnRenamed("max(kept)", "s").collect()}
    assert share[1]
    counts = {(r["quality"], r["kept"]): r["count"] for r in got.filter("n_words >= 20").groupBy("quality", "kept").count().collect()}
    assert counts[1, True] >= 0.97 * (counts[1, True] + counts.get((1, False), 0))
    assert counts[0, False] >= 0.8 * (counts[0, False] + counts.get((0, True), 0))


def test_quality_without_labels(odd_docs, labels):
    assert linecrf.judge(odd_docs, linecrf.fit(odd_docs, labels.limit(0))).count() == odd_docs.count()


def test_ogg_round_trip(texts):
    def one(t):
        raw = t.encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), 0

    got = ogg.read(ogg.encode(texts), "media", ["doc_id", "n_bytes"])
    assert pairs(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "damaged") == expected(texts, one)


def test_ogg_checksum_and_damage():
    def slow(data):
        crc = 0
        for b in data:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
        return crc

    data = bytes(range(256)) * 600
    assert ogg.page_crc(data[:1000]) == slow(data[:1000])
    media = ogg.to_ogg(data)
    got = ogg.from_ogg(media)
    assert b"".join(p for p, _ in got["samples"]) == data and not got["damaged"] and len(got["firsts"]) == 2
    assert [t for _, t in got["samples"]] == [min((k + 1) * ogg.PACKET, len(data)) / ogg.RATE for k in range(-(-len(data) // ogg.PACKET))]
    assert len(ogg.FIRST_SAMPLES) == 28 and got["firsts"][ogg.SAMPLES] == ogg.FIRST_SAMPLES
    hurt = bytearray(media)
    hurt[5000] ^= 1
    assert ogg.from_ogg(bytes(hurt))["damaged"] >= 1


def test_ogg_damage_is_counted_and_never_raised():
    import random

    rnd = random.Random(12)
    data = rnd.randbytes(700_000)
    media = ogg.to_ogg(data)
    cuts = {data[k : k + ogg.PACKET] for k in range(0, len(data), ogg.PACKET)}
    places = [m.start() for m in re.finditer(b"OggS", media)]
    for trial in range(400):
        hurt = bytearray(media)
        if trial % 4 == 0:  # a field of a page head
            at = rnd.choice(places) + rnd.randrange(28)
            hurt[at] ^= rnd.randrange(1, 256)
        elif trial % 4 == 1:  # bytes lost
            at = rnd.randrange(len(hurt))
            del hurt[at : at + rnd.randrange(1, 5000)]
        elif trial % 4 == 2:  # a whole page lost
            k = rnd.randrange(len(places))
            del hurt[places[k] : (places[k + 1] if k + 1 < len(places) else len(hurt))]
        else:  # bytes put in
            at = rnd.randrange(len(hurt))
            hurt[at:at] = rnd.randbytes(rnd.randrange(1, 300)) + b"OggS" * rnd.randrange(3)
        got = ogg.from_ogg(bytes(hurt))
        assert got["damaged"] >= 1 and all(p in cuts for p, _ in got["samples"])
    for junk in (b"", b"OggS", b"OggS" * 50, rnd.randbytes(3000), media[:40]):
        assert ogg.from_ogg(junk)["damaged"] >= 1


def check_packing(df, rows, vocabulary):
    library = Tokenizer.from_file(vocabulary)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.001 * total
    want = {}
    for r in df.select("doc_id", "text").collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.setdefault(r["doc_id"], []).append(b"".join(i.to_bytes(4, "little") for i in ids))
    assert set(want) == set(by_doc)
    for doc, all_ids in want.items():
        assert sum(r["length"] for r in by_doc[doc]) == sum(len(x) // 4 for x in all_ids)
        if len(all_ids) == 1:
            at = 0
            for r in sorted(by_doc[doc], key=lambda r: r["start"]):
                assert (r["start"], r["doc_tokens"]) == (at, len(all_ids[0]) // 4)
                assert r["ids_crc32"] == zlib.crc32(all_ids[0][4 * at : 4 * (at + r["length"])])
                at += r["length"]


def test_packing(texts):
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(texts, vocabulary)
    rows = got.collect()
    check_packing(texts, rows, vocabulary)
    assert sorted(map(repr, rows)) == sorted(map(repr, packing.pack(texts, vocabulary).collect()))


def test_packing_small_pools_and_steps():
    import random

    rnd = random.Random(4)
    packer = packing.Packer(0, pool_tokens=20_000)
    for k in range(3000):
        packer.add(k, bytes(4 * rnd.choice([1, 30, 200, 900, 3000, 9000])))
    packer.finish()
    sizes, steps = {}, {}
    for r in packer.rows:
        sizes[r[5]] = sizes.get(r[5], 0) + r[2]
    for r in packer.rows:
        steps.setdefault(r[8], {})[r[5]] = sizes[r[5]]
        assert sizes[r[5]] == r[7]
    tokens = sorted(sum(s.values()) for s in steps.values())
    assert max(tokens) <= 1.5 * packing.STEP_TOKENS and min(tokens) >= 0.5 * packing.STEP_TOKENS
    inner = tokens[len(tokens) // 4 : -len(tokens) // 4]
    assert max(inner) - min(inner) <= 4096


def test_token_ids_of_strange_texts():
    """Words whose letters compose with a mark in one case only, special strings, and random code points."""
    import random

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    library, words = Tokenizer.from_file(vocabulary), packing.WordIds(vocabulary, 2)
    rnd = random.Random(7)
    letters = "aAbThHJjWwYyéÉß 12'!.=<|>\n" + "\u030c\u0331\u0308\u030a\u0301\u0327\u0338\u0323"
    every = [a + b for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz=<" for b in map(chr, range(0x300, 0x370))]
    every += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 25))) for _ in range(60000)]
    every += ["".join(chr(rnd.choice([rnd.randint(0, 0x3FF), rnd.randint(0, 0xD7FF), rnd.randint(0xE000, 0x10FFFF)])) for _ in range(12)) for _ in range(40000)]
    got = words.encode([t.encode() for t in every])
    want = library.encode_batch(every, add_special_tokens=False)
    bad = [t for t, g, e in zip(every, got, want, strict=True) if g != b"".join(i.to_bytes(4, "little") for i in [*e.ids, 2])]
    assert not bad, [ascii(t) for t in bad[:5]]


def test_classifier(spark):
    big = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    got = zstdquality.score(docs, zstdquality.fit(docs, labels)).withColumn("held", zstdquality.held_out("doc_id")).join(labels, "doc_id").collect()
    held = [r for r in got if r["held"]]
    assert {r["held"] for r in got} == {True, False} and all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held"] for r in got)
    good, bad = ([r["score"] for r in held if r["quality"] == y] for y in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9


def test_sample_takes_whole_texts_and_ids_with_one_label(spark):
    docs = spark.createDataFrame([(1, "a" * 50_000), (1, "b"), (2, "two"), (3, None), (4, "four"), (None, "none"), (5, "five")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    sample = lambda rows: sorted(((r["__text"].encode(), r["__label"]) for r in linecrf.labelled_sample(rows, labels, "doc_id", "text", "quality", 10).collect()), key=lambda r: -r[1])
    got = sample(docs)
    assert len(got) == 2 and got[1] == (b"four", 0) and got[0] in ((b"a" * 50_000, 1), (b"b", 1))
    hot = docs.crossJoin(spark.range(500)).select("doc_id", "text")
    assert sample(hot) == got


def test_training_gathers_bounded_pieces_of_whole_texts(spark):
    """Stretches and pieces are those of the whole texts; beyond the bound, as many as it allows."""
    rnd = random.Random(3)
    texts = ["\n".join("x" * rnd.randint(1, 40) for _ in range(rnd.choice([1, 48, 49, 500]))) for _ in range(12)] + [""]
    rows = [(f"{k:02}", k % 2, t) for k, t in enumerate(texts)]
    sample = spark.createDataFrame(rows, "__id string, __label int, __text string").repartition(3)
    got, bad = linecrf.labelled_stretches(sample)
    cut = [(t.split("\n")[a : a + 48], 1 - y) for _, y, t in rows for a in range(0, t.count("\n") + 1, 48)]
    assert bad == [y for _, y in cut] and list(map(len, got)) == [len(lines) for lines, _ in cut]
    whole = linecrf.Lines([t.encode() for t in texts]).features
    assert [line for x in got for line in x.tolist()] == whole.tolist()
    assert len(linecrf.labelled_stretches(sample, 5)[0]) == 5
    ranked = sample.selectExpr("CAST(__id AS int) AS rank", "__text")
    assert b"".join(zstdquality.pieces_of(ranked)) == "".join(texts).encode()
    assert len(zstdquality.pieces_of(ranked, 3)) == 3 and set(zstdquality.pieces_of(ranked, 3)) <= set(zstdquality.pieces_of(ranked))


def test_classifier_on_odd_rows(odd_docs, labels):
    for known in (labels, labels.limit(0)):
        model = zstdquality.fit(odd_docs, known)
        got = zstdquality.score(odd_docs, model).collect()
        assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
        assert zstdquality.score(odd_docs.limit(0), model).count() == 0
