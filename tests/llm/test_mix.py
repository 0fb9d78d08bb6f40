import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hazardflow.llm import source_mix

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        whole = sum(weight[s] for s in names if s not in full) or 1
        goal = {s: float(cap * sizes[s]) if s in full else left * weight[s] / whole for s in names}
        above = {s for s in names if s not in full and goal[s] > cap * sizes[s]}
        if not above:
            return goal
        full |= above


def check(docs, **more):
    rows = docs.select("doc_id", "source", "text").collect()
    sizes, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        n = len(WORD.findall(r.text or ""))
        sizes[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    goal = plain_targets(sizes)
    got = source_mix.taken(docs, **more).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source]) and r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    for s, goal_words in goal.items():
        assert abs(taken[s] - goal_words) <= largest[s] / 2 + 1e-6, s
    return got


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(3)
    share = {"a": 900, "b": 400, "c": 60, "ü": 8, "": 30, None: 200, "empty": 5}
    rows, i = [], 0
    for source, n in share.items():
        for _ in range(n):
            size = 0 if source == "empty" else rng.choice([1, 5, 30, 400])
            rows.append((i, "w " * size if i % 50 else None, source))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def test_targets_and_words(sources):
    got = check(sources)
    rates = {r.source: r.target / r.source_size for r in got if r.source_size}
    for r in got:  # the certain copies, and one more at most
        if r.source_size:
            assert int(rates[r.source]) <= r.copies <= -(-rates[r.source] // 1)


def test_runs_agree_whatever_the_partitions(sources):
    first = sorted(map(str, source_mix.taken(sources).collect()))
    assert first == sorted(map(str, source_mix.taken(sources.repartition(11)).collect()))
    assert first != sorted(map(str, source_mix.taken(sources, seed=7).collect()))


def test_all_levels_find_the_same_cut(sources):
    rows = source_mix.measured(sources)
    rated = source_mix.written(source_mix.rates(rows, source_mix.targets(rows)), "rates")
    drawn = source_mix.ranked(rows, rated)
    assert sorted(map(str, source_mix.cuts(drawn, rated, small=0).collect())) == sorted(map(str, source_mix.cuts(drawn, rated).collect()))


def test_pareto_order_against_a_plain_one(sources):
    """The rows with one copy more are the first of their source by odds over odds, up to the missing words."""
    rows = source_mix.measured(sources)
    draws = {r.doc_id: r.u for r in rows.collect()}
    by_source = defaultdict(list)
    for r in source_mix.taken(sources).collect():
        by_source[r.source].append(r)
    for group in by_source.values():
        if group[0].source_size:
            rate = group[0].target / group[0].source_size
            order = sorted(group, key=lambda r: draws[r.doc_id] / (1 - draws[r.doc_id]))
            extra = [r.copies - int(rate) for r in order if r.size]
            assert extra == sorted(extra, reverse=True)


def test_equal_rows_and_one_hot_source(spark):
    rows = [(7, "one two three", "hot")] * 30000 + [(i, "four five " * (i % 9), f"s{i % 4}") for i in range(600)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6))


def test_likings_give_unequal_odds(spark):
    rows = [(i, "w " * 10, "s" if i % 2 else "t", i % 4) for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, liking int")
    got = source_mix.taken(docs, weights=(1, 3), preference="liking").join(docs.select("doc_id", "liking"), "doc_id")
    mean = {(r.source, r.liking): r.m for r in got.groupBy("source", "liking").agg(F.avg("copies").alias("m")).collect()}
    assert mean["s", 3] == pytest.approx(3 * mean["s", 1], rel=0.1)  # 1/2 of the words: 0.25 and 0.75 copies
    assert mean["t", 0] == 0 and mean["t", 2] == 3  # likings 0 and 2: what is liked stops at the cap
    assert [tuple(r) for r in got.groupBy("source").agg(F.sum("taken")).collect() if r.source == "s"] == [("s", 20000)]


def test_mixed_documents_and_odd_rows(odd, none, clashing):
    check(odd)
    check(clashing)
    mixed = source_mix.mixed_documents(clashing)
    assert mixed.columns == clashing.columns
    words = F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(source_mix.WORD)))
    assert mixed.agg(words).first()[0] == source_mix.taken(clashing).agg(F.sum("taken")).first()[0]
    assert source_mix.taken(none).collect() == [] and source_mix.mixed_documents(none).collect() == []
    check(odd.withColumn("text", F.lit(None).cast("string")))
