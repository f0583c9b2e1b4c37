"""Periodic runs, token files and spelling variants against brute force, library ids and round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from laminar.llm import periodicruns, queries, spelling, tokenfile

from .conftest import DATA

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=24, exponent=3):
    """Each period's maximal stretches, by comparing words q apart."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        same = [words[k] == words[k + q] for k in range(len(words) - q)] + [False]
        start = None
        for k, x in enumerate(same):
            if x and start is None:
                start = k
            if not x and start is not None:
                if k + q - start >= max(least, exponent * q):
                    found.setdefault((start, k + q), q)
                start = None
    return sorted((s, e - s, q) for (s, e), q in found.items())


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_row(doc_id, text):
    words = planted(doc_id, text)
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    kept = [w for k, w in enumerate(words) if k not in gone]
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(kept)))


def test_runs_of_random_words():
    rnd = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(4):
            k = rnd.choice([1, 2, 3, 5, 30])
            words = [str(rnd.randrange(k)) for _ in range(rnd.randint(0, 90))]
            for _ in range(rnd.randint(0, 3)):
                block = [str(rnd.randrange(k)) for _ in range(rnd.randint(1, 12))]
                at = rnd.randint(0, len(words))
                words[at:at] = (block * 30)[: rnd.randint(1, 90)]
            texts.append(words)
        for least, exponent in ((24, 3), (5, 2), (2, 2), (10, 2.5)):
            assert periodicruns.runs_in(texts, least, exponent) == [plain_runs(w, least, exponent) for w in texts]


def test_query_of_periodic_runs(spark, docs):
    got = sorted(tuple(r) for r in queries.op11_periodic_runs(spark, DATA).collect())
    rows = docs.select("doc_id", "text").collect()
    # Brute force is quadratic, so long texts are compared by a tenth of them only where they are planted.
    short = {r[0]: plain_row(*r) for r in rows if len((r[1] or "").split()) < 1500}
    assert len(got) == len(rows) and len(short) > 100
    assert [r for r in got if r[0] in short] == sorted(short.values())
    assert any(r[1] for r in got)


def test_odd_rows_of_periodic_runs(spark, odd_docs):
    made = periodicruns.periodic_runs(periodicruns.with_tandem_repeats(odd_docs))
    assert made.columns == ["doc_id", "n_words", "runs", "start", "length", "period", "exponent_milli", "collapsed"]
    rows = {(r["doc_id"], r["n_words"]): r for r in made.collect()}
    for r in odd_docs.select("doc_id", "text").collect():
        words = planted(*r)
        got = rows[(r[0], len(words))]
        if len(words) < 5000:
            assert [tuple(x) for x in got["runs"]] == plain_runs(words)
    long = next(r for r in rows.values() if r["n_words"] > 20000)
    assert (long["start"], long["period"]) == (0, 6) and len(long["collapsed"].split()) == 6
    assert periodicruns.periodic_runs(odd_docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodicruns.periodic_runs(odd_docs, exponent=1)


def test_units_are_the_librarys_ids():
    rnd = random.Random(3)
    parts = [" ", "  ", "\n", "\n\n", " \n", "a", "bc", "É", "é", "日", "'s", "'", "’s", ".", "!!", "1", "23", "<|endoftext|>", "\t", "　", "\x85", "\x1c", "é", "\U0001f600", "\r\n", "_", "²", "don't", "\xa0", " ", "“", "—", "x1"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(8000)]
    want = [e.ids for e in Tokenizer.from_file(BPE).encode_batch_fast(texts, add_special_tokens=False)]
    mine = tokenfile.UnitIds(BPE)
    got = [x.tolist() for k in range(0, len(texts), 7) for x in mine.encode([t.encode() for t in texts[k : k + 7]])]
    assert got == want


def test_variable_length_round_trip():
    rnd = np.random.default_rng(1)
    for most in (1, 200, 255, 256, 70_000, 1 << 24, (1 << 32) - 1):
        for n in (0, 1, 3, 4, 1001):
            ranks = rnd.integers(0, most, n, np.uint32, endpoint=True)
            control, data = tokenfile.encoded(ranks)
            assert len(control) == -(-n // 4) and (tokenfile.decoded(control, data, n) == ranks).all()
    with pytest.raises(ValueError):
        tokenfile.decoded(control, data[:-1], 1001)


def plain_ids(rows, end_id):
    """Sorted rows' (id, start, n, crc32)."""
    library = Tokenizer.from_file(BPE)
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, *end_id], "<u4").tobytes() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, zlib.crc32(ids[k])))
    out, start = [], 0
    for k in order:
        out.append((rows[k][0], start, len(ids[k]) // 4, zlib.crc32(ids[k])))
        start += len(ids[k]) // 4
    return out


def in_order(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[1], r[2]))


def test_token_files(spark, docs, odd_docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert in_order(queries.op12_token_file(spark, DATA)) == plain_ids(rows, [0])
    odd = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    for end_id, block_ids in ((0, 50), (None, 1000)):
        made = tokenfile.round_trip(odd_docs, BPE, end_id, block_ids=block_ids)
        assert made.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        assert Counter(tuple(r) for r in made.collect()) == Counter(plain_ids(odd, [] if end_id is None else [end_id]))
    assert tokenfile.round_trip(odd_docs.limit(0), BPE).count() == 0


def test_token_files_hold_ids_and_notice_damage(spark, tmp_path):
    docs = spark.createDataFrame([(7, "b c"), (3, "a <|endoftext|> z"), (None, None)], "doc_id long, text string")
    tokenfile.write_tokens(docs, str(tmp_path / "t"), BPE, 5, blocks_per_file=1, block_ids=1)
    read = tokenfile.with_starts(tokenfile.read_tokens(spark, str(tmp_path / "t"), with_ids=True))
    got = {r["doc_id"]: (r["start"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()) for r in read.collect()}
    library = Tokenizer.from_file(BPE)
    first = [*library.encode("a <|endoftext|> z").ids, 5]
    assert got == {3: (0, first), 7: (len(first), [*library.encode("b c").ids, 5]), None: (len(first) + 3, [5])}
    content = bytearray(tokenfile.block_of(0, 0, 0, [1], [np.array([0, 1])], np.array([0, 1], np.uint32)))
    assert next(tokenfile.read_blocks(memoryview(content)))[4].tolist() == [0, 1]
    content[-1] ^= 1
    for broken in (content, content[:-3], content[:20]):
        with pytest.raises(ValueError):
            list(tokenfile.read_blocks(memoryview(broken)))


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts, least_length=6, least_count=5):
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    near = {w: [] for w in words}
    listed = sorted(words)
    for k, a in enumerate(listed):
        for b in listed[:k]:
            if abs(len(a) - len(b)) < 2 and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {w: min(x, key=lambda y: (-words[y], y)) for w, x in near.items() if x}
    form = {w: f for w, f in form.items() if words[f] >= 5 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def plain_counts(rows, damage):
    out = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if damage and doc_id is not None and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return out


def variants(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def test_query_of_spelling_variants(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = plain_variants(plain_counts(rows, 199))
    assert variants(queries.op13_spelling_variants(spark, DATA)) == want and any(r[1] for r in want)


def test_odd_rows_of_spelling_variants(spark, odd_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    for damage in (None, 2):
        got = variants(spelling.spelling_variants(spelling.word_counts(odd_docs, damage=damage), 3, 1))
        assert got == plain_variants(plain_counts(rows, damage), 3, 1)
    assert spelling.spelling_variants(spelling.word_counts(odd_docs.limit(0))).count() == 0


@pytest.mark.parametrize(("hot", "alphabet"), [(2048, "abÿ"), (4, "abÿ"), (4, "abcdefghij")])
def test_hot_keys_and_chains_of_words(spark, monkeypatch, hot, alphabet):
    monkeypatch.setattr(spelling, "HOT", hot)
    monkeypatch.setattr(spelling, "BLOCK_PAIRS", 64)
    rnd = random.Random(9)
    counts = Counter({"".join(rnd.choices(alphabet, k=rnd.randint(1, 9))): rnd.choice([5, 6, 30, 200, 2000]) for _ in range(400)})
    counts |= {"chains" + "s" * k: 7**k for k in range(1, 8)}
    words = spark.createDataFrame([*counts.items(), ("chainss", 3), (None, 9), ("nullnull", None)], "word string, n long").repartition(3)
    counts["chainss"] += 3
    for least in (6, 1):
        assert variants(spelling.spelling_variants(words, least, 5)) == plain_variants(counts, least, 5)
