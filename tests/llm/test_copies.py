"""Near copies, repeated passages and repeated units against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hazardflow.llm import golay, intervals, unit_dedup
from hazardflow.llm.components import components
from tests.llm.conftest import SCHEMA, odd_rows


def key(x):
    return tuple((v is None, v or 0) for v in x)


def made_rows(seed=4):
    """Copies, near copies and shared passages over a small vocabulary."""
    dice = random.Random(seed)
    words = ["".join(dice.choice("abcdefghij") for _ in range(dice.randint(2, 9))) for _ in range(400)]
    passage = " ".join(dice.choice(words) for _ in range(60))
    rows, texts = [], []
    for i in range(160):
        text = " ".join(dice.choice(words) for _ in range(dice.randint(0, 150)))
        if i % 4 == 1 and texts:
            own = dice.choice(texts).split()
            for _ in range(dice.randint(0, 3)):
                if own:
                    own[dice.randrange(len(own))] = dice.choice(words)
            text = " ".join(own)
        if i % 5 == 2:
            cut = dice.randrange(len(text) + 1)
            text = text[:cut] + passage[dice.randint(0, 40) : dice.randint(60, len(passage))] + text[cut:]
        texts.append(text)
        rows.append((1000 - 3 * i, text, "en", "web", len(text)))
    return rows


# Fingerprints and links


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    prints = [plain_print(t) for _, t, *_ in rows]
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for (d, *_), p in zip(rows, prints, strict=True):
        if d is not None:
            least[find(p)] = min(d, least.get(find(p), d))
    return [(d, p - (1 << 64) if p >> 63 else p, least.get(find(p))) for (d, *_), p in zip(rows, prints, strict=True)]


@pytest.mark.parametrize("make", [odd_rows, made_rows])
def test_near_groups(spark, make):
    docs = spark.createDataFrame(make(), SCHEMA)
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in golay.near_groups(docs).collect()]
    assert sorted(got, key=key) == sorted(plain_groups(make()), key=key)


def test_near_groups_of_clashing_and_empty(clashing, none):
    assert golay.near_groups(clashing).count() == len(odd_rows())
    assert golay.near_groups(none).count() == 0


def test_three_errors_always_meet():
    dice = np.random.default_rng(0)
    one = dice.integers(0, 2**64, 20_000, dtype=np.uint64)
    two = one.copy()
    for _ in range(3):
        two ^= np.where(dice.random(len(one)) < 0.95, np.uint64(1) << dice.integers(0, 64, len(one)).astype(np.uint64), np.uint64(0))
    met = np.zeros(len(one), bool)
    for asked, (answered, mask) in zip(golay.keys_of(one)[0], golay.keys_of(two)[1], strict=True):
        met |= ((asked[:, None] == answered) & mask).any(1)
    assert met.all()


def test_golay_code_is_perfect():
    errors, near, full = golay._tables()
    assert len(set(errors.tolist())) == 2048 and np.bitwise_count(errors).max() == 3 and full.sum() == 1771
    words = np.random.default_rng(1).integers(0, 1 << 23, 500)
    nearest, answers, used = golay.codeword_keys(words)
    information = np.arange(4096) << 11
    codewords = information ^ golay._remainder(information)
    away = np.bitwise_count(words[:, None] ^ codewords[None, :])
    assert (away.argmin(1) == nearest).all()
    for row, keys, mask in zip(away, answers, used, strict=True):
        wanted = set(np.flatnonzero(row <= 4)) if row.min() == 3 else {int(row.argmin())}
        assert set(keys[mask]) == wanted


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 200 + i) for i in range(50)]
    rows = spark.createDataFrame(chain + star + [(7, 7), (100, 200)], "a long, b long")
    got = {r.node: r.root for r in components(rows).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100} | {200 + i: 100 for i in range(50)}
    assert components(rows.limit(0)).count() == 0


def test_one_of_each_similar_group(spark):
    base = [f"w{i}" for i in range(300)]
    close = base[:150] + ["changed"] + base[151:]
    other = [f"v{i}" for i in range(300)]
    texts = [base, close, base, other, [], [], ["a", "b"], ["a", "b"], None]
    rows = [(9 - i, None if t is None else " ".join(t), "en", None, 1) for i, t in enumerate(texts)] + [(None, " ".join(base), None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = golay.one_of_each(docs, golay.similar_groups(docs))
    assert kept.columns == docs.columns
    # 7, 8, 9 and the unnamed one are one group; an empty text is like a null one
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 6, 7]


def test_similar_groups_of_odd_rows(odd, clashing, none):
    want = sorted(key((r.doc_id,)) for r in golay.one_of_each(odd, golay.similar_groups(odd)).collect())
    got = golay.one_of_each(clashing, golay.similar_groups(clashing))
    assert sorted(key((r.doc_id,)) for r in got.collect()) == want and got.columns == clashing.columns
    assert golay.one_of_each(none, golay.similar_groups(none)).count() == 0


def test_similar_texts_meet_past_the_smallest_of_their_keys(spark):
    words = [f"w{i}" for i in range(300)]
    mixed = random.Random(1).sample(words, 300)
    texts = [words, mixed, mixed[:299] + ["changed"]]
    docs = spark.createDataFrame([(i, " ".join(t), "en", None, 1) for i, t in enumerate(texts)], SCHEMA)
    roots = {r.doc_id: r.root for r in golay.similar_groups(docs).collect()}
    assert roots[1] == roots[2] != roots[0]


def templated_rows(seed=6):
    """Short and long texts with edits at all places, many of them around one licence."""
    dice = random.Random(seed)
    licence, texts = [f"l{i}" for i in range(60)], []
    for i in range(160):
        own = [f"w{dice.randrange(500)}" for _ in range(dice.choice([3, 12, 24, 60, 200]))]
        base = licence + own[:30] if i % 3 == 0 else own
        for _ in range(3):
            edited = list(base)
            for _ in range(dice.randint(0, 3)):
                edited[dice.choice([0, -1, dice.randrange(len(edited))])] = f"e{dice.randrange(99)}"
            texts.append(" ".join(edited))
    dice.shuffle(texts)
    return [(i, t, "en", None, 1) for i, t in enumerate(texts)]


def similar_roots(rows, size=5, similarity=0.8):
    parts = [t.split() for _, t, *_ in rows]
    sets = [{tuple(p[i : i + size]) for i in range(max(1, len(p) - size + 1))} for p in parts]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return sorted({t: root[d] for d, t, *_ in rows}.values())


def test_similar_groups_lose_no_pair(spark):
    rows = templated_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    found = golay.similar_groups(docs).collect()
    least = {}
    for r in found:
        least[r.root] = min(r.doc_id, least.get(r.root, r.doc_id))
    assert sorted(least[r.root] for r in found) == similar_roots(rows)


def edited_rows(copies, seed=9):
    """One text and its edits: a few of one word, half of 9 to 13 (near the text, far from each other), half of 22 (far from all)."""
    dice = random.Random(seed)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base)]
    for i in range(copies):
        own = list(base)
        for place in dice.sample(range(400), 1 if i < 10 else dice.randint(9, 13) if i % 2 else 22):
            own[place] = f"e{i}x{place}"
        texts.append(" ".join(own))
    dice.shuffle(texts)
    return [(i, t, "en", None, 1) for i, t in enumerate(texts)]


def test_edited_copies_of_one_text_are_not_paired_with_each_other(spark, monkeypatch):
    sizes, measured = [], golay.measured

    def counted(pairs, *rest):
        sizes.append(pairs.count())
        return measured(pairs, *rest)

    monkeypatch.setattr(golay, "measured", counted)
    rows = edited_rows(200)
    found = golay.similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    least = {}
    for r in found:
        least[r.root] = min(r.doc_id, least.get(r.root, r.doc_id))
    assert sorted(least[r.root] for r in found) == similar_roots(rows)
    assert sum(sizes) < 5 * len(rows)


def test_hub_links_grow_with_the_fingerprints(spark):
    dice = np.random.default_rng(3)
    center = dice.integers(0, 2**62)
    prints = np.unique([center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in dice.integers(0, 62, (300, 2))])
    frame = spark.createDataFrame([(0, int(p)) for p in prints], "seed int, fingerprint long")
    some = {(r.a, r.b) for r in golay.hub_links(frame).collect()}
    every = {(r.a, r.b) for r in golay.links(frame).collect()}
    assert some and some <= every and all((a ^ b).bit_count() <= 3 for a, b in some)
    assert len({b for _, b in some} | {a for a, _ in some}) > 0.9 * len(prints)


# Repeated byte strings


def plain_removed(rows, least=50):
    first = {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - least + 1):
                s = b[i : i + least]
                first[s] = min(d, first.get(s, d))
    out = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - least + 1):
                if first[b[i : i + least]] < d:
                    gone[i : i + least] = b"\1" * least
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("make", [odd_rows, made_rows, lambda: made_rows(11)])
def test_removed_bytes(spark, make):
    docs = spark.createDataFrame(make(), SCHEMA)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in intervals.report(docs).collect()]
    order = lambda r: (key(r[:4]), r[4])
    assert sorted(got, key=order) == sorted(plain_removed(make()), key=order)


def test_hot_minimizers_and_small_parts(spark, monkeypatch):
    for name, value in {"CHUNK_BYTES": 9000, "BLOCK_BYTES": 5000, "SLICE": 700, "BWT_BYTES": 900}.items():
        monkeypatch.setattr(intervals, name, value)
    docs = spark.createDataFrame(made_rows(), SCHEMA)
    found = intervals.removed_spans(docs, hot=3)
    kept = {r.doc_id: hashlib.sha256(r.kept).hexdigest() for r in found.collect()}
    want = {d: sha for d, _, _, _, sha in plain_removed(made_rows())}
    assert all(want[d] == sha for d, sha in kept.items())


def test_counts_of_one_chunk_reach_the_hot_number():
    many = intervals.HOT + 1
    value, times = intervals._counted(np.array([7] * many + [3], np.uint64))
    carried = np.frombuffer(times.tobytes(), np.uint32)
    assert value.tolist() == [3, 7] and carried.tolist() == [1, many]
    assert all(len(x) == 0 for x in intervals._counted(np.zeros(0, np.uint64)))


def test_classes_are_those_of_equal_prefixes():
    dice = random.Random(8)
    for letters in (b"ab", b"abcdefghij"):
        base = bytes(dice.choice(letters) for _ in range(400))
        strings = [base[a : a + 75] for a in range(0, 300, 7)] + [bytes(dice.choice(letters) for _ in range(80)) for _ in range(20)]
        strings = list(dict.fromkeys(strings))
        order, group = intervals.window_classes(strings)
        text = b"\xff".join(strings) + b"\xff" * 60
        seen = {}
        for p, g in zip(order, group, strict=True):
            prefix = text[p : p + 50]
            if b"\xff" not in prefix:
                assert seen.setdefault(prefix, g) == g
        assert len(set(seen.values())) == len(seen)


def test_cut_documents(spark, odd, clashing, none):
    rows = {r.doc_id: r for r in intervals.cleaned_documents(odd.filter("doc_id is not null")).collect()}
    assert rows[3].text.strip().endswith("end") and len(rows[3].text) < 60
    assert rows[4].text is None and rows[5].text == "" and rows[18].text == "é" * 80
    assert set(rows[19].text) <= {"é", "z"} and rows[19].n_chars == len(rows[19].text)
    assert intervals.cleaned_documents(clashing).columns == clashing.columns
    assert intervals.cleaned_documents(none).count() == 0 and intervals.report(none).count() == 0


def test_cut_texts_are_what_the_spans_leave(spark, odd):
    docs = odd.filter("doc_id is not null")
    spans = {(r.k1, r.k2): r for r in intervals.removed_spans(docs, whole_characters=True).collect()}
    keyed = docs.join(intervals.keyed_texts(docs).select("doc_id", "k1", "k2").distinct(), "doc_id")
    want = set()
    for r in keyed.collect():
        one = spans[r.k1, r.k2]
        copy = r.doc_id > one.doc_id and len((r.text or "").encode()) >= 50
        want.add((r.doc_id, None if r.text is None else "" if copy else bytes(one.kept).decode()))
    assert {(r.doc_id, r.text) for r in intervals.cleaned_documents(docs).collect()} == want
    many = spark.createDataFrame([("aéb日c", [(0, 1), (3, 4)]), ("aéb日c", []), ("aéb日c", None), ("日", [(0, 3)]), ("", [])], "t string, s array<struct<start: long, stop: long>>")
    assert [r[0] for r in many.select(intervals._cut_out(F.col("t"), F.col("s"))).collect()] == ["é日c", "aéb日c", "aéb日c", "", ""]


# Units


def plain_units(rows):
    ranked = {}
    for d, t, *_ in rows:
        for place, unit in enumerate((t or "").split("\n")):
            plain = b" ".join(unit.encode().lower().split())
            if plain:
                code = (d is None, d or 0, xxhash.xxh64_intdigest((t or "").encode()), place)
                ranked.setdefault(plain, set()).add(code[:2] + (t or "", place))
    out = []
    for d, t, *_ in rows:
        units, at, spans = (t or "").split("\n"), 0, []
        for place, unit in enumerate(units):
            plain = b" ".join(unit.encode().lower().split())
            if plain and min(ranked[plain])[:2] + (min(ranked[plain])[3],) < (d is None, d or 0, place):
                spans.append((at, at + len(unit)))
            at += len(unit) + 1
        out.append((d, len(units), len(spans), sum(b - a for a, b in spans), ",".join(f"{a}-{b}" for a, b in spans)))
    return out


def test_units(spark):
    rows = [(5, "A  b\nc\n\nc", None, None, None), (3, "a b\nd", None, None, None), (4, "C\r\nd \t\né", None, None, None), (6, None, None, None, None), (7, "", None, None, None), (None, "d\nnew", None, None, None), (3, "a b\nd", None, None, None)]
    got = [tuple(r) for r in unit_dedup.report(spark.createDataFrame(rows, SCHEMA)).collect()]
    order = lambda r: (key(r[:4]), r[4])
    assert sorted(got, key=order) == sorted(plain_units(rows), key=order)


def test_units_cut(spark, odd, clashing, none):
    rows = [(1, "x\n\ny y", None, None, None), (2, "Y  Y\n\nz\n\nx", None, None, None), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.text for r in unit_dedup.cleaned_documents(docs, unit_dedup.PARAGRAPH).collect()}
    assert got == {1: "x\n\ny y", 2: "z\n\n", 3: None}
    assert unit_dedup.cleaned_documents(clashing).columns == clashing.columns
    assert unit_dedup.report(odd).count() == len(odd_rows()) and unit_dedup.report(none).count() == 0


def plain_sentences(text):
    """Units letter by letter: each ends after a line break, or after marks that a space, a line break or the end follows."""
    out, at, i = [], 0, 0
    while i < len(text):
        stop = text[i] == "\n"
        if text[i] in ".!?" and (i + 1 == len(text) or text[i + 1] in " \n"):
            i, stop = min(i + 1, len(text) - 1), True
        i += 1
        if stop:
            out.append((at, text[at:i]))
            at = i
    return out + [(at, text[at:])] * (at < len(text))


def test_sentences_of_lines(spark, odd, clashing, none):
    dice = random.Random(8)
    texts = ["".join(dice.choice("ab .!?\n") for _ in range(dice.randint(0, 40))) for _ in range(500)] + ["3.14 is. a?!b ... \n\n.", "x" * 99 + "."]
    for text in texts:
        assert list(unit_dedup.pieces(text, unit_dedup.SENTENCE)) == plain_sentences(text)
    passage = " ".join(f"w{i}" for i in range(12)) + ". And Then it goes on for more than eight words here!"
    own = [f"Start {i} of a line {passage} {'short one. ' * 2}End {i}.\nLast" for i in range(30)]
    rows = [(i, t, None, None, 0) for i, t in enumerate(own)] + [(40, None, None, None, 0), (41, "", None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in unit_dedup.report(docs, unit_dedup.SENTENCE, unit_dedup.LEAST).collect()}
    first, want = set(), {}
    for i, text in enumerate(own):
        spans = []
        for at, unit in plain_sentences(text):
            plain = tuple(unit.lower().split())
            if len(plain) >= unit_dedup.LEAST and plain in first:
                spans.append(f"{at}-{at + len(unit)}")
            first.add(plain)
        want[i] = ",".join(spans)
    assert {i: got[i].spans for i in range(30)} == want and got[0].n_removed == 0 and got[1].n_removed == 1
    assert got[40].n_units == got[41].n_units == 0
    cut = {r.doc_id: r.text for r in unit_dedup.cleaned_documents(docs, unit_dedup.SENTENCE, unit_dedup.LEAST).collect()}
    assert cut[0] == own[0] and cut[1] == own[1].replace("And Then it goes on for more than eight words here! ", "") and cut[40] is None
    assert unit_dedup.report(odd, unit_dedup.SENTENCE).count() == len(odd_rows()) and unit_dedup.report(none, unit_dedup.SENTENCE).count() == 0
    assert unit_dedup.cleaned_documents(clashing, unit_dedup.SENTENCE).columns == clashing.columns


def test_hot_units_are_joined_apart_with_equal_results(odd, monkeypatch):
    plain = sorted(map(str, unit_dedup.report(odd).collect()))
    monkeypatch.setattr(unit_dedup, "HOT", 1)
    assert sorted(map(str, unit_dedup.report(odd).collect())) == plain
