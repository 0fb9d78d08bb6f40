"""Runs of periodic words in a text, by maximal pairs.

A run is a stretch of words with smallest period q (words q apart are equal) that has at least
max(least, 2q) words and that no neighbouring word extends. Two places of a text form a maximal
pair if the words from there on agree for exactly `depth` words and the words before them differ.
A maximal pair whose distance q is at most its depth and whose depth plus q reaches `least` is a
run from the first place, depth + q words long; nothing is left to extend. A multiple of the
smallest period gives a pair over the same stretch, so the least distance of a stretch is its period.

Per batch the words of all texts get numbers and their suffixes are sorted text by text by prefix
doubling; common prefixes come from the ranks of all doublings. The LCP intervals of a text are
merged bottom-up. An interval keeps the places of its suffixes in one list per left word, and a
merge looks for pairs only between lists of different left words, smaller interval against larger,
within the distance that the depth allows. Clusters of suffixes (depth 4 or what `least` asks for)
whose left words are all equal, or whose nearest places lie further apart than their greatest depth,
hold no run and are passed over.

Scale: row by row, no shuffle; memory is that of one slice of a batch (4 MB of text, or one text if
that is longer: about 4 bytes a word for each doubling).

Edge cases: null and empty texts have no words, no runs and an empty collapsed text; very long texts
are searched whole; equal rows get equal results; an empty table gives no rows; only the columns
named are read, so other columns may have any names. The planted period of `with_period` depends on
the id alone; a null id plants none.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardflow.llm.common import lists_of, sliced
from hazardflow.llm.text_metrics import words_of

LEAST = 12
FEW = 8
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS_TYPE = "array<struct<start: bigint, length: bigint, period: bigint>>"


def doubled_ranks(words: np.ndarray, owner: np.ndarray, last: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words within their text, until all differ.

    Equal prefixes of one text have equal ranks; ranks of different texts never meet. last is the end
    of the text of each place.
    """
    n = len(words)
    key = owner << 32 | words
    order = np.argsort(key)
    key = key[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    ranks, steps, step = [rank.astype(np.int32)], [1], 1
    sizes = np.bincount(rank, minlength=n)
    tied = np.flatnonzero(sizes[rank] > 1)
    while len(tied):
        beyond = tied + step
        follow = np.where(beyond < last[tied], rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = rank[tied] << 32 | follow
        order = np.argsort(key)
        key, tied = key[order], tied[order]
        group = key >> 32
        place = np.arange(len(tied))
        opens = np.concatenate([[True], group[1:] != group[:-1]])
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.maximum.accumulate(np.where(opens, place, 0))
        fresh = group + np.maximum.accumulate(np.where(new, place, 0)) - start
        rank = rank.copy()
        rank[tied] = fresh
        step *= 2
        ranks.append(rank.astype(np.int32))
        steps.append(step)
        alone = new & np.concatenate([new[1:], [True]])
        tied = tied[~alone]
    return ranks, steps


def common_prefixes(a: np.ndarray, b: np.ndarray, last: np.ndarray, ranks: list[np.ndarray], steps: list[int]) -> np.ndarray:
    """How many words the suffixes at a and b (of one text that ends at last) share."""
    found = np.zeros(len(a), np.int64)
    n = len(ranks[0])
    for rank, step in zip(reversed(ranks), reversed(steps), strict=True):
        at, to = a + found, b + found
        inside = (at < last) & (to < last)
        equal = inside & (rank[np.minimum(at, n - 1)] == rank[np.minimum(to, n - 1)])
        found += np.where(equal, step, 0)
    return found


class Interval:
    """The places of an LCP interval, one sorted list per left word; `every` joins them once there are many."""

    __slots__ = ("lists", "size", "every")

    def __init__(self, left: int, place: int):
        self.lists = {left: [place]}
        self.size = 1
        self.every: list[int] | None = None

    def near(self, place: int, left: int, depth: int) -> Iterator[int]:
        """The nearest places on both sides within `depth`, of lists of another left word."""
        if len(self.lists) > FEW:
            if self.every is None:
                self.every = sorted(p for places in self.lists.values() for p in places)
            own = self.lists.get(left, ())
            at = bisect_left(self.every, place)
            for other in self.every[max(0, at - 1) : at + 1]:
                if abs(other - place) <= depth and not (own and _holds(own, other)):
                    yield other
            return
        for word, places in self.lists.items():
            if word != left:
                at = bisect_left(places, place)
                for other in places[max(0, at - 1) : at + 1]:
                    if abs(other - place) <= depth:
                        yield other

    def take(self, other: Interval) -> None:
        for left, places in other.lists.items():
            if left in self.lists:
                _join(self.lists[left], places)
            else:
                self.lists[left] = places
            if self.every is not None:
                _join(self.every, places)
        self.size += other.size


def _holds(places: list[int], place: int) -> bool:
    at = bisect_left(places, place)
    return at < len(places) and places[at] == place


def _join(places: list[int], more: list[int]) -> None:
    if len(more) * 8 < len(places):
        for place in more:
            insort(places, place)
    else:
        places.extend(more)
        places.sort()


def cluster_runs(places: list[int], lefts: list[int], depths: list[int], least: int, runs: dict[tuple[int, int], int]) -> None:
    """Add the runs among suffixes in sorted order; depths[k] is the common prefix of k and k + 1.

    runs maps (start, end) to the least distance found.
    """

    def merged(a: Interval, b: Interval, depth: int) -> Interval:
        if a.size < b.size:
            a, b = b, a
        if 2 * depth >= least and (len(a.lists) > 1 or a.lists.keys() != b.lists.keys()):
            for left, own in b.lists.items():
                for place in own:
                    for other in a.near(place, left, depth):
                        first, gap = min(place, other), abs(place - other)
                        if depth + gap >= least:
                            stretch = (first, first + depth + gap)
                            runs[stretch] = min(gap, runs.get(stretch, gap))
        a.take(b)
        return a

    stack: list[tuple[int, Interval]] = []
    current = Interval(lefts[0], places[0])
    for k, depth in enumerate(depths):
        while stack and stack[-1][0] > depth:
            above, done = stack.pop()
            current = merged(done, current, above)
        if stack and stack[-1][0] == depth:
            stack[-1] = (depth, merged(stack[-1][1], current, depth))
        else:
            stack.append((depth, current))
        current = Interval(lefts[k + 1], places[k + 1])
    while stack:
        above, done = stack.pop()
        current = merged(done, current, above)


def runs_of(words: np.ndarray, owner: np.ndarray, least: int = LEAST) -> dict[str, np.ndarray]:
    """start (place among all words), length and period of the runs of all texts, in order of start and period.

    words are numbers below 2**31, owner the ascending number of the text of each word.
    """
    floor = -(-least // 2)  # a pair's distance is at most its depth, so depth is at least half a run
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    if n > floor:
        last = np.searchsorted(owner, owner, side="right")
        ranks, steps = doubled_ranks(words, owner, last)
        order = np.empty(n, np.int64)
        order[ranks[-1]] = np.arange(n)
        same = owner[order[1:]] == owner[order[:-1]]
        tied = np.flatnonzero(same & (words[order[1:]] == words[order[:-1]]))
        depth = np.zeros(n - 1, np.int64)
        a, b = order[tied], order[tied + 1]
        depth[tied] = common_prefixes(a, b, last[a], ranks, steps)
        left = np.where(np.concatenate([[True], owner[1:] != owner[:-1]]), -1, np.concatenate([[-1], words[:-1]]))
        deep = depth >= floor
        edges = np.diff(np.concatenate([[0], deep.astype(np.int8), [0]]))
        opens, closes = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)  # cluster: suffixes opens..closes
        if len(opens):
            mixed = np.concatenate([[0], np.cumsum((left[order[1:]] != left[order[:-1]]) & deep)])
            differs = mixed[closes] > mixed[opens]
            opens, closes = opens[differs], closes[differs]
        if len(opens):
            sizes = closes - opens + 1
            cluster = np.repeat(np.arange(len(opens)), sizes)
            member = np.repeat(opens - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            by_place = np.lexsort((order[member], cluster))
            sorted_places = order[member][by_place]
            gaps = np.diff(sorted_places, append=0)
            ends = np.cumsum(sizes) - 1
            gaps[ends] = n + 1
            nearest = np.minimum.reduceat(gaps, ends - sizes + 1)
            deepest = np.maximum.reduceat(np.append(depth, 0), np.stack([opens, closes], 1).ravel())[::2]
            for x, y in zip(opens[nearest <= deepest].tolist(), closes[nearest <= deepest].tolist(), strict=True):
                at = order[x : y + 1]
                cluster_runs(at.tolist(), left[at].tolist(), depth[x:y].tolist(), least, found)
    rows = sorted((start, period, end - start) for (start, end), period in found.items())
    start, period, length = np.array(rows, np.int64).reshape(-1, 3).T
    return {"start": start, "length": length, "period": period}


def _searched(texts: pa.Array, least: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs and the collapsed text of each text."""
    words, owner = words_of(texts)
    owner = owner.astype(np.int64)
    coded = words.dictionary_encode()
    runs = runs_of(coded.indices.to_numpy().astype(np.int64), owner, least)
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    whose = owner[runs["start"]] if len(runs["start"]) else np.zeros(0, np.int64)
    columns = [runs["start"] - first[whose], runs["length"], runs["period"]]
    structs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(RUN))
    lists = lists_of(structs, np.bincount(whose, minlength=len(texts)))
    marks = np.zeros(len(owner) + 1, np.int64)
    np.add.at(marks, runs["start"] + runs["period"], 1)
    np.add.at(marks, runs["start"] + runs["length"], -1)
    stays = np.cumsum(marks)[:-1] == 0
    kept = words.filter(pa.array(stays))
    collapsed = pc.binary_join(lists_of(kept, np.bincount(owner[stays], minlength=len(texts))), " ")
    return pa.array(counts, pa.int64()), lists, collapsed


def found_column(text: str = "text", least: int = LEAST) -> Column:
    """Struct of n_words, runs (start, length and period in words) and collapsed of each text.

    collapsed has the words that stay, joined by one space: of every run only the first period stays.
    """

    @F.arrow_udf(f"struct<n_words: bigint, runs: {RUNS_TYPE}, collapsed: string>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [_searched(part.column(0), least) for part in sliced(iter([pa.record_batch([texts], ["text"])]))]
            if parts:
                columns = [pa.concat_arrays(c) for c in zip(*parts, strict=True)]
            else:
                columns = [pa.array([], pa.int64()), pa.array([], pa.list_(RUN)), pa.array([], pa.string())]
            yield pa.StructArray.from_arrays(columns, ["n_words", "runs", "collapsed"])

    return found(text)


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs and collapsed of every row."""
    return docs.select("doc_id", found_column("text", least).alias("found")).select("doc_id", "found.*")


def with_period(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a planted period in every text whose id's CRC-32 h is divisible by 10.

    There each word from number a = g % n on becomes word a + (i - a) % p, with g = h div 10 and
    p = 1 + (n - a) div (3 + g % 8). Other texts stay as they are.
    """
    split = F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")
    check = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", check.alias("h")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, F.filter(split, lambda w: w != ""))
    )
    rows = rows.withColumns({"n": F.size("words").cast("long"), "g": F.expr("h div 10")})
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    place = F.expr("transform(sequence(0L, n - 1), i -> if(i < a, i, a + (i - a) % p))")
    planted = F.array_join(F.transform(place, lambda i: F.get("words", i.cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The longest run and the digests of all runs and of the collapsed text, per row."""
    best = F.aggregate(
        "runs",
        F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"),
        lambda top, run: F.when(top.isNull() | (run["length"] > top["length"]), run).otherwise(top),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    rows = periodic_runs(docs, least).withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
