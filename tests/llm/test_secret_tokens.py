"""Random tokens wherever they stand and however few digits they have."""

import random
import string

import numpy as np

from laminar.llm import secretscan

BASE64 = string.ascii_letters + string.digits + "+/"


def found(spark, docs, texts):
    planted = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = secretscan.find_secrets(docs.select("doc_id", "text").union(planted)).collect()
    clean = [r for r in rows if r["doc_id"] < 10**6]
    assert sum("random" in r["spans"] for r in clean) <= 0.02 * len(clean)
    return {r["doc_id"] - 10**6: r["spans"] for r in rows if r["doc_id"] >= 10**6}


def test_tokens_behind_equals_colons_and_quotes(spark, docs):
    rnd = random.Random(12)
    before = ["SESSION_KEY=", "/get?key=", "a_very_long_setting_name_of_ours=", "id:", 'x="', "x = '"]
    codes = ["".join(rnd.choices(secretscan.ENCODINGS["base62"], k=32)) for _ in range(60)]
    texts = [f"now {before[k % 6]}{c}{'&x=1' if k % 6 == 1 else ''} and more" for k, c in enumerate(codes)]
    got = found(spark, docs, texts)
    at = [texts[k].index(c) for k, c in enumerate(codes)]
    for kind in range(6):
        assert sum(f"random:{at[k]}:{at[k] + 32}" in got[k] for k in range(kind, 60, 6)) >= 8


def test_tokens_with_few_digits(spark, docs):
    rnd = random.Random(13)
    codes = []
    while len(codes) < 60:
        c = "".join(rnd.choices(BASE64, k=24))
        if sum(map(str.isdigit, c)) < 2:
            codes.append(c)
    got = found(spark, docs, [f"look at {c} now" for c in codes])
    assert sum("random:8:32" in got[k] for k in range(60)) >= 40
    words = ["internationalization", "Donaudampfschifffahrtsgesellschaft", "path/to/some/ordinary/file", "getElementByIdentifierAndName", "one-two-three-four-five-six"]
    got = found(spark, docs, [f"look at {w} now" for w in words])
    assert not any("random" in s for s in got.values())


def test_tokens_with_marks_of_both_alphabets(spark, docs):
    rnd = random.Random(17)
    codes = ["".join(rnd.choices(secretscan.ENCODINGS["coded"], k=38)) + "+-" for _ in range(40)]
    got = found(spark, docs, [f"look at x{c} now" for c in codes])
    assert sum("random:8:49" in got[k] for k in range(40)) >= 28
    got = found(spark, docs, [f"look at {w} now" for w in ("one-two/three_four-five+six-seven", "src/main-part/some_file_name-with/many_words")])
    assert not any("random" in s for s in got.values())


def test_redaction_of_tokens_behind_equals(spark, docs):
    rnd = random.Random(14)
    codes = ["".join(rnd.choices(secretscan.ENCODINGS["base62"], k=40)) for _ in range(30)]
    planted = spark.createDataFrame([(10**6 + k, f"SESSION_KEY={c} x") for k, c in enumerate(codes)], "doc_id long, text string")
    got = [r["text"] for r in secretscan.redact(docs.select("doc_id", "text").union(planted)).filter("doc_id >= 1000000").collect()]
    assert sum(t == "SESSION_KEY=[SECRET] x" for t in got) >= 27


def test_every_window_of_a_text_counts_and_no_band_is_off(spark, docs):
    rnd = random.Random(15)
    text = "héllo, wörld; it's (so) punctuated! " * 60
    plain = secretscan.ordinary(text, [])
    counts = [sum(n for c, n in secretscan.text_windows([plain]) if c // secretscan.BINS == b) for b in range(secretscan.BANDS)]
    assert counts == [len(plain) // n for n in secretscan.LENGTHS]
    for e, (_, alphabet, _) in enumerate(secretscan.SETS):  # the scores are those of single tokens
        words = ["".join(rnd.choices(sorted(alphabet), k=40)) for _ in range(40)]
        words = [w for w in words if next(k for k, s in enumerate(secretscan.SETS) if set(w) <= s[1]) == e]
        v = secretscan.INDEX[e][np.array([list(w.encode()) for w in words], np.uint8).T]
        assert np.allclose(secretscan.window_scores(v, e), [secretscan.score(w) for w in words])
    # Texts of another script give no window; long keys are found all the same.
    codes = ["".join(rnd.choices(secretscan.ENCODINGS["base62"], k=n)) for n in (24, 32, 48, 80, 140) for _ in range(10)]
    other = spark.createDataFrame([(k, f"это ключ {c} для входа") for k, c in enumerate(codes)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secretscan.find_secrets(other).collect()}
    for k in range(0, 50, 10):
        assert sum("random" in got[j] for j in range(k, k + 10)) >= 7


def test_spans_that_a_token_meets():
    rnd = random.Random(16)
    for _ in range(300):
        spans = sorted((a, a + rnd.randint(1, 9)) for a in (rnd.randint(0, 60) for _ in range(rnd.randint(0, 6))))
        meets = secretscan.meets(spans)
        for _ in range(20):
            a = rnd.randint(0, 70)
            b = a + rnd.randint(1, 12)
            assert meets(a, b) == any(s < b and a < e for s, e in spans)
