import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from hazardflow.llm import source_audit
from tests.llm.conftest import SCHEMA

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_report(rows):
    """All shares and all pairs, term by term."""
    docs = [(r["lang"] or "", r["source"] or "", Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")))) for r in rows]
    df, groups, tongue = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        df[lang].update(terms.keys())
        groups[lang, source].update(terms)
        tongue[lang].update(terms)
    out = []
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= 10]

        def shares(counts, kept=kept):
            whole = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // whole for t in kept}

        p, q = shares(groups[lang, source]), shares(tongue[lang])
        terms = [(-((p[t] - q[t]) ** 2 // (p[t] + q[t])), t.encode()) for t in kept if groups[lang, source][t] and p[t] > q[t]]
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                r = shares(groups[lang, other])
                pairs.append((-sum((p[t] - r[t]) ** 2 // (p[t] + r[t]) for t in kept), other.encode()))
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
            out += [(lang, source, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def check(docs):
    assert sorted(map(tuple, source_audit.report(docs).collect())) == plain_report(docs.collect())


def texts(rng, n):
    words = [f"{w}{x}" for w in ("Über", "ab", "日本", "Z", "q'") for x in "abcdefgh"]
    for i in range(n):
        source = rng.choice(["s1", "s2", "s2", "s3", None, "é"])
        body = " ".join(rng.choice(words[: 10 + 7 * len(source or "")]) for _ in range(rng.randint(0, 40)))
        yield (i, rng.choice([body, body + ".X1Y", None]) if i % 3 else body, rng.choice(["en", "en", "fr", None]), source, 1)


def test_against_all_terms(spark):
    rows = list(texts(random.Random(4), 400)) + [(900, None, "en", "no text", 0), (901, "rare words only", "xx", "a", 1), (902, "", "xx", "b", 1)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(5))


def test_blocks_give_the_same_sums(spark):
    docs = spark.createDataFrame(list(texts(random.Random(6), 200)), SCHEMA)
    whole = sorted(map(tuple, source_audit.Audit(docs).distances().collect()))
    assert whole == sorted(map(tuple, source_audit.Audit(docs, block=3).distances().collect()))


def test_odd_rows(odd, none, clashing):
    check(odd)
    check(clashing.select("doc_id", "text", "lang", "source", "score").withColumn("term", F.lit("x")).withColumn("n", F.lit(1)))
    assert source_audit.report(none).collect() == []


def test_equal_rows_of_one_hot_group(spark):
    rows = [(1, "same words again, same", "en", "hot", 1)] * 20000 + [(2, "same other words", "en", f"s{i % 3}", 1) for i in range(90)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(6))


def test_galloping():
    rng = np.random.default_rng(1)
    for size in (0, 1, 5, 300, 5000):
        for other in (0, 1, 70, 40000):
            a, b = (np.unique(rng.integers(0, 60000, n)) for n in (size, other))
            at = source_audit.galloped(a, b)
            assert [x in set(b.tolist()) for x in a.tolist()] == (at >= 0).tolist()
            assert (b[at[at >= 0]] == a[at >= 0]).all()


def test_shares_are_exact():
    rng = random.Random(2)
    for _ in range(2000):
        whole = rng.randint(2, rng.choice([10, 10**6, 2**53 - 1]))
        count = rng.randint(0, max(0, whole - 2))
        assert source_audit.shares(np.array([count]), whole)[0] == 1 + 10**9 * (count + 2) // whole


def test_packed_round_trip():
    ids, counts = np.array([0, 3, 4, 70000]), np.array([1, 2**40, 7, 255])
    assert [x.tolist() for x in source_audit.unpacked(source_audit.packed(ids, counts))] == [ids.tolist(), counts.tolist()]
