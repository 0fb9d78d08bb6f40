"""Mixing sources to target weights with Pareto order sampling.

Sources share the words of the whole corpus by weight; a target stops at CAP times what its source
holds, and the excess is shared again by weight until no target is above. The rate of a source is its
target over its words. A document is expected rate times (times its preference, if a column gives
one); the whole part of that number is certain copies, and the rest is the odds of one copy more:
with U uniform from a hash of the document, rows are ranked by (U / (1 - U)) / (p / (1 - p)), p the
rest, and the sample takes ranks until the words still missing are reached, the last one if that
comes nearer. Sizes are fixed in words, so each source misses its target by less than one document.

The rank is kept as an ordered whole number (48 bits of Q / (1 + Q), then 16 bits of the row's place,
which only tells equal rows apart). Its sixteen-bit digits are searched level by level: words per
source and digit are counted, the digit that holds the cut is opened, and the next level reads its
rows only. The result is one cut per source, so whether a row is taken needs no sort and no join by
document.

Scale: texts are read once; all else reads the written table of sizes and draws. A level shuffles at
most 65,536 counts per source and task, so a hot source is split like any other and nothing is sorted
whole; a cut digit with at most SMALL rows is ordered at once. Shares are found by rounds of one aggregate
over the written table of sources, which never reaches the driver; it sees four numbers per round. Rates
and cuts are joined to the rows by broadcast up to a checked size, by salted keys beyond it.

Edge cases: null and empty texts have size 0, are expected like others and add no words; null is a
source of its own and comes last; sources without words have target 0; repeated rows are drawn one
by one; equal rows differ by their place in the written table; an empty table gives no rows; names
of other columns do not matter, as only doc_id, text, source and the preference are read. The
hash depends on id, text and seed, so that runs agree whatever the partitions are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardflow.operators.lookup import attach_written
from hazardflow.operators.numbering import position_in_group
from hazardflow.session import written

WEIGHTS = (5, 2, 1)
CAP = 3
DIGIT = 1 << 16
SMALL = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def measured(docs: DataFrame, seed: int = 42, preference: str | None = None, whole: bool = False) -> DataFrame:
    """doc_id, source, size (words), liking, u (uniform, from a hash of id and text) and place of every row, written.

    whole adds the row itself, for `mixed_documents`.
    """
    text = F.coalesce("text", F.lit(""))
    draw = F.xxhash64(F.col("doc_id").cast("string"), text, F.lit(seed))
    liking = F.lit(1) if preference is None else F.greatest(F.coalesce(F.col(f"`{preference}`").cast("int"), F.lit(0)), F.lit(0))
    rows = docs.select(
        "doc_id",
        "source",
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        liking.alias("liking"),
        ((F.shiftrightunsigned(draw, 11) + F.lit(0.5)) / F.lit(float(1 << 53))).alias("u"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(DIGIT)).alias("place"),
        *([F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row")] if whole else []),
    )
    return written(rows, "mix-rows")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, weight and target of every source.

    weights repeat over the sources in order of code points, null last.
    """
    sizes = written(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    named = sizes.withColumn("unnamed", F.col("source").isNull())
    turns = position_in_group(named, [], ["unnamed", "source"], "turn")
    shared = F.array(*[F.lit(w) for w in weights])
    each = written(turns.select("source", "source_size", F.get(shared, (F.col("turn") % len(weights)).cast("int")).alias("weight")), "mix-weights")
    full = F.lit(False)
    previous = -1
    while True:  # every round fills at least one more source
        found = each.agg(
            F.sum("source_size").alias("words"),
            F.sum(F.when(full, F.col("source_size") * cap)).alias("held"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
            F.count_if(full).alias("filled"),
        ).first()
        rate = ((found["words"] or 0) - (found["held"] or 0)) / (found["open"] or 1)
        full = F.col("weight") * F.lit(rate) > F.col("source_size") * cap
        if found["filled"] == previous:
            break
        previous = found["filled"]
    target = F.when(full, (F.col("source_size") * cap).cast("double")).otherwise(F.col("weight") * F.lit(rate))
    return each.withColumn("target", target)


def rates(rows: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """The goals with `rate`: copies per unit of liking, such that the expected words are the target.

    min(cap, rate * liking) copies are expected. Likings are whole numbers, so the most liked ones that
    stop at the cap are found from the words of each liking; if all stop there, the target is missed.
    """
    by_liking = rows.groupBy("source", "liking").agg(F.sum("size").alias("words"))
    most_first = Window.partitionBy("source").orderBy(F.desc("liking"))
    before = most_first.rowsBetween(Window.unboundedPreceding, -1)
    rest = most_first.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    run = by_liking.withColumns(
        {"stopped": F.coalesce(F.sum("words").over(before), F.lit(0)), "open": F.sum(F.col("words") * F.col("liking")).over(rest)}
    )
    rate = (F.col("target") - cap * F.col("stopped")) / F.col("open")
    fits = _by_source(run, goals).filter((F.col("open") > 0) & (rate * F.col("liking") <= cap * (1 + 1e-12)))
    found = fits.groupBy("source").agg(F.max_by(rate, "liking").alias("rate"))
    missed = F.when(F.col("target") > 0, float(cap)).otherwise(0.0)
    return _by_source(goals, found).withColumn("rate", F.coalesce("rate", missed))


def _by_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join of two tables of sources; null matches null."""
    other = right.withColumnRenamed("source", "source of mix")
    return left.join(other, F.col("source").eqNullSafe(F.col("source of mix")), "left").drop("source of mix")


def ranked(rows: DataFrame, rated: DataFrame, cap: int = CAP) -> DataFrame:
    """The rows with `certain` copies and `rank`: the Pareto order as a whole number, null without odds.

    rated is a written table.
    """
    expected = F.least(F.lit(float(cap)), F.col("rate") * F.col("liking"))
    copies = attach_written(rows, rated, ["source"]).withColumns({"expected": expected, "certain": F.floor(expected)})
    chance = F.col("expected") - F.col("certain")
    q = F.col("u") / (1 - F.col("u")) / (chance / (1 - chance))
    high = F.least(F.floor(q / (1 + q) * F.lit(float(1 << 48))), F.lit((1 << 48) - 1))
    rank = F.shiftleft(high - F.lit(1 << 47), 16) + F.col("place")  # signed, in order
    return copies.withColumn("rank", F.when(chance > 0, rank)).drop("expected", "liking", "u", "place")


def cuts(drawn: DataFrame, rated: DataFrame, small: int = SMALL) -> DataFrame:
    """source and cut, written: rows whose rank is at most the cut get one copy more than the certain ones."""
    sure = drawn.groupBy("source").agg(F.sum(F.col("certain") * F.col("size")).alias("sure"))
    need = _by_source(rated.select("source", "target"), sure)
    need = written(need.select("source", (F.col("target") - F.coalesce("sure", F.lit(0))).alias("need")), "mix-need")
    rows = drawn.filter("rank is not null").select("source", "size", "rank")
    run = Window.partitionBy("source").orderBy("digit")
    whole = None
    for shift in (48, 32, 16):
        counts = rows.groupBy("source", F.shiftright("rank", shift).alias("digit"))
        counts = counts.agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), F.max("rank").alias("top"))
        found = _by_source(counts.withColumn("upto", F.sum("words").over(run)), need)
        # the digit in which the words still missing are reached; what lies before it is taken
        at = F.min(F.when(F.col("upto") >= F.col("need"), F.struct("digit", "upto", "words", "rows")))
        state = written(found.groupBy("source").agg(F.max("top").alias("last"), F.max("need").alias("need"), at.alias("at")), "mix-digits")
        if whole is None:  # sources that need all their rows
            whole = state.filter("at is null").select("source", F.col("last").alias("cut"))
        opened = state.filter("at is not null")
        missing = F.col("need") - (F.col("at.upto") - F.col("at.words"))
        need = written(opened.select("source", missing.alias("need"), F.col("at.digit").alias("open")), "mix-need")
        rows = attach_written(rows, need.select("source", "open"), ["source"])
        rows = rows.filter(F.col("open") == F.shiftright("rank", shift)).select("source", "size", "rank")
        need = need.select("source", "need")
        if (opened.agg(F.max("at.rows")).first()[0] or 0) <= small:
            break
        rows = written(rows, "mix-open")
    single = rows.groupBy("source", F.col("rank").alias("digit")).agg(F.sum("size").alias("words"))
    placed = _by_source(single.withColumn("upto", F.sum("words").over(run)), need)
    before = F.col("upto") - F.col("words")
    nearer = F.abs(F.col("upto") - F.col("need")) < F.abs(before - F.col("need"))
    taken = (F.col("upto") <= F.col("need")) | ((before < F.col("need")) & nearer)
    # if nothing of the opened digit is taken, all ranks before it still are
    inner = placed.groupBy("source").agg(F.coalesce(F.max(F.when(taken, F.col("digit"))), F.min("digit") - 1).alias("cut"))
    return written(whole.unionByName(inner), "mix-cuts")


def drawn_rows(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The measured rows with source_size, target and copies."""
    rated = written(rates(rows, targets(rows, weights, cap), cap), "mix-rates")
    drawn = ranked(rows, rated, cap)
    joined = attach_written(drawn, cuts(drawn, rated), ["source"])
    return joined.withColumn("copies", F.col("certain") + F.when(F.col("rank") <= F.col("cut"), 1).otherwise(0))


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 42, preference: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), copies and source of every row."""
    rows = drawn_rows(measured(docs, seed, preference), weights, cap)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def mixed_documents(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 42, preference: str | None = None
) -> DataFrame:
    """The rows of the mix with all their columns, each as often as it is taken."""
    rows = drawn_rows(measured(docs, seed, preference, whole=True), weights, cap)
    times = F.sequence(F.lit(1), F.col("copies").cast("int"))
    return rows.filter("copies > 0").select("row", F.explode(times)).select("row.*")
