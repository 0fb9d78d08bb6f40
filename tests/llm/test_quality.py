"""Quality scores, adaptive rules, the pivot index and the pipeline."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hazardflow.llm import adaptive_rules, pivot_index, quality_model
from tests.llm.conftest import SCHEMA, odd_rows

VECTORS = "vec_id long, embedding array<float>"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose_rows(n=400, seed=1):
    """Three quarters plain, the rest junk of three kinds, with their labels."""
    dice = random.Random(seed)
    words = ["".join(dice.choice("aeioulnrst") for _ in range(dice.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        own = [dice.choice(words) for _ in range(dice.randint(60, 200))]
        kind = i % 12
        if kind == 1:
            own = [w.upper() + "!!" for w in own]
        elif kind == 3:
            own = [w + dice.choice(["$$$", "%%%", "###"]) for w in own]
        elif kind == 5:
            own = [own[j // 12] for j in range(len(own))]
        rows.append((i, " ".join(own), "en", f"s{i % 3}", 1))
        labels.append((i, 0 if kind in (1, 3, 5) else 1, 0))
    return rows, labels


@pytest.fixture(scope="module")
def prose(spark):
    rows, labels = prose_rows()
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(prose):
    docs, labels = prose
    rows = quality_model.scored(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 400 and 40 < len(held) < 130
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    loss = [-math.log(max(1e-9, r.score if r.quality else 1 - r.score)) for r in held]
    assert np.mean(loss) < 0.25


def test_scores_of_odd_rows(spark, prose, odd, clashing, none):
    _, labels = prose
    strange = labels.union(spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 1, None), (2, 0, 0)], labels.schema))
    model = quality_model.fit(odd, strange)
    rows = odd.select("doc_id", quality_model.score_column(model).alias("s")).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.s <= 1 for r in rows)
    assert quality_model.scored(clashing, strange).count() == len(odd_rows())
    assert {r.score for r in quality_model.scored(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_model.scored(none, labels).count() == 0


def test_fit_sample_is_bounded_and_outside_the_held_out(prose):
    docs, labels = prose
    rows = quality_model.labelled(docs, labels, 50).withColumn("m", F.expr("crc32(cast(doc_id as string)) % 5")).collect()
    assert len(rows) == 50 and all(r.m for r in rows)


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    times, mark = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            mark |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(mark)


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_base_counts(request, table):
    rows = adaptive_rules.judged(request.getfixturevalue(table)).collect()
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()
    got = sorted([tuple(r[n] for n in names) for r in rows])
    assert got == sorted(plain_counts(t) for _, t, *_ in odd_rows())
    for r in rows:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def test_rules_keep_plain_and_reject_junk(prose):
    docs, labels = prose
    rows = adaptive_rules.judged(docs).join(labels, "doc_id").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert not any(r.kept for r in rows if r.doc_id % 12 in (1, 3))
    kept = adaptive_rules.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)


def test_sketches_merge_and_hold_their_error(spark):
    dice = random.Random(3)
    values = [dice.lognormvariate(0, 1) for _ in range(3000)]
    rows = spark.createDataFrame([(v, int(i % 3)) for i, v in enumerate(values)], "v double, part int")
    bucket = F.floor(F.log(F.col("v") / adaptive_rules.LOWEST) / math.log1p(adaptive_rules.RATIO)).cast("int")
    sketch = rows.select("part", F.lit("v").alias("name"), bucket.alias("bucket")).groupBy("part", "name", "bucket").agg(F.count(F.lit(1)).alias("n"))
    found = adaptive_rules.quantiles(sketch, [], {"q": 0.5, "high": 0.9}).first()
    assert found.docs == 3000
    for rank, got in ((0.5, found.q), (0.9, found.high)):
        assert got == pytest.approx(sorted(values)[math.ceil(rank * 3000) - 1], rel=adaptive_rules.RATIO)


def plain_verdicts(rows):
    """Verdicts by plain lists: the same quantiles of bucket middles, group by group."""
    shares = {"symbol": ("n_symbols", "word_chars", 1), "upper": ("n_upper", "word_chars", 1), "dup_line": ("n_dup_lines", "n_lines", 1), "repeat": ("n_repeat_words", "n_words", 6)}

    def middle(x):
        return 0.0 if x < adaptive_rules.LOWEST else adaptive_rules.LOWEST * (1 + adaptive_rules.RATIO) ** (math.floor(math.log(x / adaptive_rules.LOWEST) / math.log1p(adaptive_rules.RATIO)) + 0.5)

    def value(r, part, whole):
        return r[part] / r[whole] if r[whole] else 0.0

    def cuts(group, part, whole):
        found = sorted(middle(value(r, part, whole)) for r in group)
        return [found[math.ceil(q * len(found) - 1e-9) - 1] for q in (0.1, 0.5, 0.9)]

    good = [r for r in rows if not r.base_failed]
    out = {}
    for r in rows:
        own = [x for x in good if (x.lang, x.source) == (r.lang, r.source)]
        tongue = [x for x in good if x.lang == r.lang]
        wide = tongue if len(tongue) >= adaptive_rules.MIN_DOCS else good
        near = own if len(own) >= adaptive_rules.MIN_DOCS else wide
        broken = r.base_failed
        for part, whole, grain in [*shares.values(), ("word_chars", "n_words", 0)]:
            if r.base_failed:
                break
            (low, mid, high), (low2, _, high2) = cuts(near, part, whole), cuts(wide, part, whole)
            width = min(max(high - low, (high2 - low2) / 2), 2 * (high2 - low2))
            if grain:
                expected = (mid + 3 * width) * r[whole]
                broken |= r[part] > expected + 3 * math.sqrt(grain * expected) + 9 * grain
            else:
                broken |= not mid - 3 * width <= value(r, part, whole) <= mid + 3 * width
        out[r.doc_id] = not broken
    return out


@pytest.mark.parametrize("least", [100, 20, 1000])
def test_verdicts_against_brute_force(spark, prose, monkeypatch, least):
    monkeypatch.setattr(adaptive_rules, "MIN_DOCS", least)
    docs, _ = prose
    words = "ab cdefg hijk lmnopq rst uvwxy".split()
    odd = [(1000 + i, " ".join(words[(i + j * j) % 6] * (1 + i % 4) + str(i * j) for j in range(52 + i)), None if i % 2 else "xx", None, 1) for i in range(40)]
    odd += [(2000, " ".join(f"{'w' * 40}{i}" for i in range(60)), "en", "s0", 1), (2001, " ".join(chr(97 + i % 26) for i in range(60) for _ in "a") , "en", "s0", 1)]
    rows = adaptive_rules.judged(docs.union(spark.createDataFrame(odd, SCHEMA))).collect()
    assert {r.doc_id: r.kept for r in rows} == plain_verdicts(rows)
    assert {r.kept for r in rows} == {True, False}
    assert all(bool(r.broken) != r.kept for r in rows if not r.base_failed)


def test_bounds_follow_groups_and_rejections_add_up(prose):
    docs, _ = prose
    rows = adaptive_rules.judged(docs)
    assert rows.columns[:8] == adaptive_rules.CONTRACT
    assert rows.select("max_word_length").distinct().count() == 3
    told = adaptive_rules.rejections(rows).collect()
    assert sum(r.docs for r in told) == rows.filter("not base_failed").count()
    assert sum(r.max_symbol_share for r in told) == rows.filter("broken like '%max_symbol_share%' and not base_failed").count() > 0


def test_rules_on_empty_and_clashing(none, clashing):
    assert adaptive_rules.judged(none).count() == 0 and adaptive_rules.kept_documents(none).count() == 0
    assert adaptive_rules.kept_documents(clashing).columns == clashing.columns


# Pivot index


def plain_top(rows, k=5):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return out


def vectors(n=600, size=6, seed=0):
    dice = np.random.default_rng(seed)
    centres = dice.normal(size=(7, size))
    rows = [(int(i), (centres[i % 7] + 0.2 * dice.normal(size=size)).astype(float).tolist()) for i in range(n)]
    rows[3] = (3, None)
    rows[4] = (4, [1.0] * (size - 1) + [None])
    rows[50] = (50, [float("nan")] * size)
    rows[100] = (100, [0.0] * size)
    rows[150] = (150, [1.0, 2.0])
    rows[151] = (151, [2.0, 2.0])
    rows[200] = (200, [])
    for i in range(300, 460):
        rows[i] = (i, [0.5] * size)  # one very common vector
    return [*rows, (None, [1.0] * size)]


@pytest.mark.parametrize("small", [False, True])
def test_search_is_exact(spark, monkeypatch, small):
    if small:
        for name, value in {"ANNULUS": 16, "PIVOTS": 5, "QUERIES": 3, "SAMPLE": 60}.items():
            monkeypatch.setattr(pivot_index, name, value)
    table = spark.createDataFrame(vectors(), VECTORS).withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))
    found = pivot_index.top_k(table, table.filter("vec_id % 50 = 0"))
    assert sorted(tuple(r) for r in found.collect()) == sorted(plain_top(vectors()))


def test_search_of_nothing(spark):
    table = spark.createDataFrame([], VECTORS)
    assert pivot_index.top_k(table, table).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0])], VECTORS)
    assert [tuple(r) for r in pivot_index.top_k(few, few.filter("vec_id = 0")).collect()] == [(0, 1, 1, 256 * 256 * 5)]


# Pipeline


def test_pipeline_stages(spark, prose, tmp_path):
    docs, labels = prose
    copies = docs.filter("doc_id % 60 = 0").withColumn("doc_id", F.col("doc_id") + 1000)
    whole = docs.union(copies).union(spark.createDataFrame(odd_rows()[4:8], SCHEMA).withColumn("doc_id", F.col("doc_id") + 5000))
    whole.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    table, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, table, str(tmp_path)).write.parquet(str(tmp_path / name.replace(" ", "-")))
        before, table = table, spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        seen[name] = {r.doc_id for r in table.select("doc_id").collect()}
        assert seen[name] <= {r.doc_id for r in before.select("doc_id").collect()}
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert table.columns == docs.columns
    good = {i for i in range(400) if i % 12 not in (1, 3, 5)}
    assert good <= seen["simhash near-dedup"] and not any(i >= 1000 for i in seen["simhash near-dedup"])
    assert {i for i in seen["quality rules"] if i < 400 and i % 12 in (1, 3)} == set()
    got = sorted((r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == sorted((r.doc_id, r.piece, r.length) for r in table.collect())


def test_pipeline_of_nothing_and_clashing(spark, none, clashing, prose, tmp_path):
    prose[1].write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (none, clashing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
