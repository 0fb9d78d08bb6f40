import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from hazardflow.llm import periodic_runs

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_runs(words, least=12):
    """(start, length, period) of every run, by trying every period."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        start = 0
        equal = [words[i] == words[i + q] for i in range(n - q)] + [False]
        for i, e in enumerate(equal):
            if not e:
                length = i - start + q
                if i > start and length >= max(least, 2 * q):
                    best.setdefault((start, length), q)
                start = i + 1
    return sorted((s, q, length) for (s, length), q in best.items())


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, q, length in runs for i in range(s + q, s + length)}
    top = min(((-length, s, q) for s, q, length in runs), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, q, length in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
    return (doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def check(docs):
    got = [tuple(r)[:8] for r in periodic_runs.report(periodic_runs.with_period(docs)).collect()]
    want = [expected(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def random_words(rng):
    words = [rng.choice("abc") for _ in range(rng.randint(0, 50))]
    for _ in range(rng.randint(0, 3)):
        unit = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))]
        words += (unit * rng.randint(1, 7))[: rng.randint(1, 40)] + [rng.choice("abcxyz") for _ in range(rng.randint(0, 4))]
    return words


def test_all_texts_of_a_batch():
    rng = random.Random(5)
    texts = [random_words(rng) for _ in range(400)]
    codes = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    words = np.array([codes[w] for t in texts for w in t], np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    first = np.cumsum([0] + [len(t) for t in texts])
    for least in (12, 2, 5):
        got = periodic_runs.runs_of(words, owner, least)
        want = [(first[i] + s, q, length) for i, t in enumerate(texts) for s, q, length in plain_runs(t, least)]
        assert list(zip(got["start"], got["period"], got["length"], strict=True)) == want


def test_many_left_words_and_nested_runs():
    line = "a b c d e f g".split()
    words = [w for i in range(60) for w in [f"x{i}", *line]] + ["z"] * 300 + (["p", "q"] * 20 + ["r"]) * 9
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    got = periodic_runs.runs_of(np.array([codes[w] for w in words], np.int64), np.zeros(len(words), np.int64))
    assert list(zip(got["start"], got["period"], got["length"], strict=True)) == plain_runs(words)


def test_long_single_word_text(spark):
    docs = spark.createDataFrame([(3, "w " * 30000), (4, " ".join(f"w{i % 4001}" for i in range(20000)))], "doc_id long, text string")
    rows = {r.doc_id: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert [tuple(r) for r in rows[3].runs] == [(0, 30000, 1)] and rows[3].collapsed == "w"
    assert [tuple(r) for r in rows[4].runs] == [(0, 20000, 4001)] and len(rows[4].collapsed.split()) == 4001


def test_odd_rows(odd, none, clashing):
    short = odd.filter("doc_id is null or doc_id not in (11, 12)")
    check(short)
    assert periodic_runs.report(none).collect() == []
    assert sorted(map(str, periodic_runs.report(clashing).collect())) == sorted(map(str, periodic_runs.report(odd).collect()))


def test_planted_periods(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["one", "two", "three\n", "\tfour", "five"]) for _ in range(rng.randint(0, 80)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(docs)
    assert docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).count() > 10


def test_equal_rows(spark):
    docs = spark.createDataFrame([(7, "a b c " * 9)] * 3000, "doc_id long, text string")
    found = periodic_runs.report(docs).groupBy("n_runs", "length", "period").count().collect()
    assert [tuple(r) for r in found] == [(1, 27, 3, 3000)]
