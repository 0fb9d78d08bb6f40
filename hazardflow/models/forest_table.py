"""Forests as tables: one row per node, walked by joins.

A node row has tree, node, depth, feature and place (its number), cut, left, right, gain and votes (one
number per class). Leaves have no feature. Values up to the cut go left. Such a table comes from a
fitted Spark forest (`exported`) or is grown here by aggregates (`grow`); it can be written, joined
and read by any SQL engine, which a saved pipeline cannot.

`grow` takes one aggregate per depth for all trees together: every row walks the levels known so far
and is counted by (tree, node, tried feature, bin, class); the best cut of each node is found from
these counts. Rows are drawn with repetition (Poisson counts from a hash of tree and key), features are
tried by a hash of tree and node, class weights multiply whole counts: equal input gives equal trees
on any cluster. Only the cuts (features times bins) and the class counts reach the driver; the levels
are joined by broadcast up to a checked size and by salted keys beyond it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardflow.functions.scalar import confidence, risk_level
from hazardflow.operators.lookup import BROADCAST_BYTES, attach_written, named, table_bytes
from hazardflow.operators.quantiles import exact_quantiles
from hazardflow.schema import FEATURES, TARGET
from hazardflow.session import written

BINS = 32
DECIMALS = 9
SHARE = 1_000_000_000
LEAST_GAIN = 1e-9
NODE_BITS = 40
NODE_SCHEMA = (
    "tree int, node bigint, depth int, feature string, place int, cut double, left bigint, right bigint, gain double, votes array<double>"
)


def drawn_limits(most: int = 9) -> list[int]:
    """Upper limits, out of 2**32, of the numbers that draw a row 0, 1, 2, ... times (Poisson of mean one)."""
    chances = [math.exp(-1) / math.factorial(i) for i in range(most)]
    return [int((1 << 32) * sum(chances[: i + 1])) for i in range(most)]


def _digits(*parts: Column) -> Column:
    """Eight hexadecimal digits from the MD5 of the parts, joined by strokes."""
    return F.substring(F.md5(F.concat_ws("/", *parts).cast("binary")), 1, 8)


def _number(*parts: Column) -> Column:
    """A number below 2**32 from the MD5 of the parts, joined by strokes."""
    return F.conv(_digits(*parts), 16, 10).cast("bigint")


def _draws(key: Column, trees: int, seed: int) -> Column:
    """How often each tree draws the row.

    The digits are made in a step of their own: an expression inside a lambda is evaluated at each use.
    Digits of one length compare as their numbers do.
    """
    limits = [f"{x:08x}" for x in drawn_limits()]
    digits = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: _digits(F.lit(str(seed)), tree.cast("string"), key))

    def times(own: Column) -> Column:
        found = F.when(own < limits[0], 0)
        for i, limit in enumerate(limits[1:], 1):
            found = found.when(own < limit, i)
        return found.otherwise(len(limits))

    return F.transform(digits, times)


def _tried(features: int, tries: int, seed: int) -> Column:
    """Numbers of the features that a node may be cut by: the least of a hash of tree, node and feature."""
    ordered = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.lit(features - 1)),
            lambda f: F.struct(
                _number(F.lit(str(seed)), F.col("tree").cast("string"), F.col("node").cast("string"), f.cast("string")).alias("h"), f.alias("f")
            ),
        )
    )
    return F.transform(F.slice(ordered, 1, tries), lambda s: s["f"])


def _bins(cuts: dict[str, list[float]], features: Sequence[str]) -> Column:
    """The number of cuts below the value of each feature."""

    def place(value: Column, edges: list[float], below: int = 0) -> Column:
        """By halves; a NULL is above no cut, a NaN above all."""
        if not edges:
            return F.lit(below)
        middle = len(edges) // 2
        above = place(value, edges[middle + 1 :], below + middle + 1)
        return F.when(value > F.lit(edges[middle]), above).otherwise(place(value, edges[:middle], below))

    return F.array(*[place(named(f).cast("double"), cuts[f]) for f in features])


def _score(weights: Sequence[float], counts: Sequence[Column]) -> tuple[Column, Column]:
    """Weight of a side, and the sum of squared class weights over it."""
    parts = [F.lit(w) * c for w, c in zip(weights, counts, strict=True)]
    whole = reduce(lambda a, b: a + b, parts)
    return whole, reduce(lambda a, b: a + b, [p * p for p in parts]) / whole


def _best_cuts(counts: DataFrame, classes: int, weights: Sequence[float], least: int) -> DataFrame:
    """tree, node, place, bin, gain, left and right class counts of the best cut of each node."""
    own = Window.partitionBy("tree", "node", "place")
    upto = own.orderBy("bin")
    rows = counts.withColumns({f"l{c}": F.sum(f"n{c}").over(upto) for c in range(classes)})
    rows = rows.withColumns({f"r{c}": F.sum(f"n{c}").over(own) - F.col(f"l{c}") for c in range(classes)})
    left, right = ([F.col(f"{side}{c}") for c in range(classes)] for side in "lr")
    both = [a + b for a, b in zip(left, right, strict=True)]
    rows = rows.withColumns({"nl": reduce(lambda a, b: a + b, left), "nr": reduce(lambda a, b: a + b, right)})
    rows = rows.filter((F.col("nl") >= least) & (F.col("nr") >= least))
    gain = _score(weights, left)[1] + _score(weights, right)[1] - _score(weights, both)[1]
    rows = rows.withColumn("gain", gain).filter(F.col("gain") > LEAST_GAIN)
    best = F.max(F.struct("gain", (-F.col("place")).alias("place"), (-F.col("bin")).alias("bin"), F.array(*left).alias("left"), F.array(*right).alias("right")))
    return rows.groupBy("tree", "node").agg(best.alias("b")).select(
        "tree", "node", (-F.col("b.place")).alias("place"), (-F.col("b.bin")).alias("bin"), "b.gain", "b.left", "b.right"
    )


def grow(
    rows: DataFrame,
    key: str,
    features: Sequence[str] = tuple(FEATURES),
    label: str = TARGET,
    trees: int = 100,
    depth: int = 8,
    tries: int | None = None,
    least: int = 1,
    balanced: bool = True,
    bins: int = BINS,
    seed: int = 42,
) -> DataFrame:
    """The nodes of a random forest over complete rows, written.

    label holds codes 0, 1, ...; key tells rows apart for the draws (rows that share it are drawn
    alike). tries features are tried per node (the root of their number, rounded up), a side of a cut has
    at least `least` drawn rows. balanced weighs classes by n / (k * n_c). An empty table gives no nodes.
    """
    features = list(features)
    tries = tries or math.ceil(math.sqrt(len(features)))
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row per class
    classes = 1 + max((int(c) for c in sizes if c is not None), default=-1)
    if not classes or None in sizes:
        if None in sizes:
            raise ValueError("a row has no label")
        return rows.sparkSession.createDataFrame([], NODE_SCHEMA)
    known = [c for c in range(classes) if sizes.get(c)]
    total = float(sum(sizes.values()))
    weights = [total / (len(known) * sizes[c]) if balanced and sizes.get(c) else 1.0 for c in range(classes)]

    found = exact_quantiles(rows, features, [j / bins for j in range(1, bins)]).filter("value IS NOT NULL")
    found = found.select("column", F.round("value", DECIMALS).alias("value")).distinct()
    cuts = {f: [] for f in features}
    for r in found.orderBy("value").collect():  # at most features * bins rows
        cuts[r["column"]].append(r["value"])
    base = rows.select(
        F.col(label).cast("int").alias("class"),
        _bins(cuts, features).alias("bins"),
        F.array(*[named(f).cast("double") for f in features]).alias("x"),
        _draws(named(key).cast("string"), trees, seed).alias("draws"),
    )
    base = written(base, "forest-rows")
    tops = base.select("bins", F.posexplode("x").alias("place", "x")).groupBy("place", F.get("bins", F.col("place")).alias("bin"))
    tops = written(tops.agg(F.max("x").alias("cut")), "forest-cuts")

    names = F.array(*[F.lit(f) for f in features])
    counted = [F.sum(F.when(F.col("class") == c, F.col("times")).otherwise(0)).alias(f"n{c}") for c in range(classes)]
    drawn = base.select("class", "bins", F.posexplode("draws").alias("tree", "times")).filter("times > 0").withColumn("node", F.lit(1).cast("bigint"))
    levels, parts = [], []
    roots = drawn.groupBy("tree", "node").agg(*counted)
    open_ = written(roots.select("tree", "node", F.array(*[F.col(f"n{c}") for c in range(classes)]).alias("counts")), "forest-level")
    for level in range(depth):
        at = _at_level(drawn, levels)
        some = _at_nodes(at, written(open_.select("tree", "node", _tried(len(features), tries, seed).alias("tried")), "forest-tried"), depth)
        long = some.select("tree", "node", "class", "times", "bins", F.explode("tried").alias("place"))
        counts = long.groupBy("tree", "node", "place", F.get("bins", F.col("place")).alias("bin")).agg(*counted)
        cut = written(_best_cuts(counts, classes, weights, least), "forest-cut")
        parts.append(open_.join(cut.select("tree", "node", "place", "bin", "gain"), ["tree", "node"], "left").withColumn("depth", F.lit(level)))
        levels.append(cut.select("tree", "node", "place", "bin"))
        sides = F.array(F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("counts")), F.struct((2 * F.col("node") + 1).alias("node"), F.col("right").alias("counts")))
        open_ = written(cut.select("tree", F.inline(sides)), "forest-level")
        if open_.isEmpty():
            break
    else:
        nothing = {"place": F.lit(None).cast("int"), "bin": F.lit(None).cast("int"), "gain": F.lit(None).cast("double"), "depth": F.lit(depth)}
        parts.append(open_.withColumns(nothing))
    every = reduce(DataFrame.unionByName, parts).join(tops, ["place", "bin"], "left")
    cut_here = F.col("place").isNotNull()
    votes = F.transform("counts", lambda n, c: n * F.get(F.array(*[F.lit(w) for w in weights]), c))
    nodes = every.select(
        "tree",
        "node",
        "depth",
        F.get(names, F.col("place")).alias("feature"),
        "place",
        "cut",
        F.when(cut_here, 2 * F.col("node")).alias("left"),
        F.when(cut_here, 2 * F.col("node") + 1).alias("right"),
        "gain",
        votes.alias("votes"),
    )
    return written(nodes, "forest-nodes")


def _at_nodes(at: DataFrame, table: DataFrame, bits: int) -> DataFrame:
    """The rows with what a written table has for their node, or NULLs; node numbers have at most `bits` bits and one.

    Tree and node make one number where the table is broadcast: it is found several times faster than a struct.
    """
    if bits >= NODE_BITS or table_bytes(table) > BROADCAST_BYTES:
        return attach_written(at, table, ["tree", "node"])
    number = F.shiftleft(F.col("tree").cast("bigint"), NODE_BITS).bitwiseOR(F.col("node")).alias("_at")
    values = [c for c in table.columns if c not in ("tree", "node")]
    return at.withColumn("_at", number).join(F.broadcast(table.select(number, *values)), "_at", "left").drop("_at")


def _at_level(drawn: DataFrame, levels: Sequence[DataFrame]) -> DataFrame:
    """The drawn rows at the open node they reach; rows that ended in a leaf are left out."""
    for depth, cut in enumerate(levels):
        drawn = _at_nodes(drawn, cut, depth).filter("place IS NOT NULL")
        right = (F.get("bins", F.col("place")) > F.col("bin")).cast("bigint")
        drawn = drawn.withColumn("node", 2 * F.col("node") + right).drop("place", "bin")
    return drawn


def exported(spark: SparkSession, model_path: str) -> DataFrame:
    """The nodes of a saved pipeline that ends in a forest, read from its files, written.

    Cuts are on the scaled features of the pipeline (`scaled`); gains are weighted by the rows of the node.
    """
    data = spark.read.parquet(f"{model_path}/stages/*_RandomForestClass*/data").select("treeID", "nodeData.*")
    inner = F.col("leftChild") >= 0
    whole = F.aggregate("impurityStats", F.lit(0.0), lambda a, b: a + b)
    nodes = data.select(
        F.col("treeID").alias("tree"),
        F.col("id").cast("bigint").alias("node"),
        F.when(inner, F.col("split.featureIndex")).alias("place"),
        F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("cut"),
        F.when(inner, F.col("leftChild").cast("bigint")).alias("left"),
        F.when(inner, F.col("rightChild").cast("bigint")).alias("right"),
        F.when(inner, F.col("gain") * whole).alias("gain"),
        F.col("impurityStats").alias("votes"),
    )
    nodes = written(nodes, "forest-saved")
    children = written(nodes.select("tree", F.explode(F.array_compact(F.array("left", "right"))).alias("node"), F.col("node").alias("parent")), "forest-edges")
    level = nodes.filter("node = 0").select("tree", "node").withColumn("depth", F.lit(0))
    depths = [level]
    while True:
        above = level.select("tree", F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth"))
        level = written(children.join(above, ["tree", "parent"]).select("tree", "node", "depth"), "forest-depth")
        if level.isEmpty():
            break
        depths.append(level)
    names = F.array(*[F.lit(f) for f in _saved_features(spark, model_path)])
    joined = nodes.join(reduce(DataFrame.unionByName, depths), ["tree", "node"])
    ordered = joined.withColumn("feature", F.get(names, F.col("place")))
    return written(ordered.select(*[c.split()[0] for c in NODE_SCHEMA.split(", ")]), "forest-nodes")


def _saved_features(spark: SparkSession, model_path: str) -> list[str]:
    return list(PipelineModel.load(model_path).stages[0].getInputCols())


def scaled(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The rows with `x`: the features as the forest of a fitted pipeline sees them; unknown ones are NaN."""
    assemble, scale = model.stages[0].copy(), model.stages[1]
    assemble.setHandleInvalid("keep")
    out = scale.transform(assemble.transform(rows))
    return out.withColumn("x", vector_to_array("features")).drop("raw_features", "features")


def walked(nodes: DataFrame, rows: DataFrame, key: str, x: Column) -> DataFrame:
    """key, votes: the class votes of the leaves that each row reaches, one part in 10**9 per tree and class.

    nodes is a written node table; x is the array of features; key identifies a row. The joins of all
    levels are in one stage where the nodes are small enough to broadcast; the votes of a row's trees
    meet in its task before they are shuffled.
    """
    shape = nodes.agg(F.max("tree").alias("trees"), F.max("depth").alias("depth"), F.max(F.size("votes")).alias("classes"), F.max("node").alias("node")).first()
    if shape["trees"] is None:
        raise ValueError("a forest without nodes")
    every = F.explode(F.sequence(F.lit(0), F.lit(shape["trees"]))).alias("tree")
    at = rows.select(named(key).alias("key"), x.alias("x"), every)
    bits = shape["node"].bit_length()
    roots = written(nodes.filter("depth = 0").select("tree", "node"), "forest-roots")
    at = attach_written(at, roots, ["tree"]).filter("node IS NOT NULL")
    steps = written(nodes.filter("feature IS NOT NULL").select("tree", "node", "depth", "place", "cut", "left", "right"), "forest-steps")
    for level in range(shape["depth"]):
        step = steps.filter(F.col("depth") == level).drop("depth")
        at = _at_nodes(at, step, bits)
        onward = F.when(F.get("x", F.col("place")) <= F.col("cut"), F.col("left")).otherwise(F.col("right"))
        at = at.withColumn("node", F.coalesce(F.when(F.col("place").isNotNull(), onward), "node")).drop("place", "cut", "left", "right")
    whole = F.aggregate("votes", F.lit(0.0), lambda a, b: a + b)
    share = F.transform("votes", lambda v: F.floor(v / whole * SHARE + 0.5))
    leaves = written(nodes.filter("feature IS NULL").select("tree", "node", F.when(whole > 0, share).alias("share")), "forest-leaves")
    reached = _at_nodes(at, leaves, bits)
    sums = [F.coalesce(F.sum(F.get("share", F.lit(c))), F.lit(0)) for c in range(shape["classes"])]
    return reached.groupBy("key").agg(F.array(*sums).alias("votes")).withColumnRenamed("key", key)


def scored(
    nodes: DataFrame,
    rows: DataFrame,
    key: str,
    features: Sequence[str] = tuple(FEATURES),
    accuracy: float = 0.95,
    version: str = "v1.0.0",
    x: Column | None = None,
) -> DataFrame:
    """key, prediction, probability, risk_level, confidence, model_version and votes of every row.

    The prediction is the class with most votes, the smallest on ties. A row without a feature (NULL or
    NaN) has NULL results.
    """
    x = F.array(*[named(f).cast("double") for f in features]) if x is None else x
    known = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))
    complete = rows.where(known)
    votes = walked(nodes, complete, key, x)
    whole = F.aggregate("votes", F.lit(0).cast("bigint"), lambda a, b: a + b)
    p = F.array_max("votes") / whole
    results = votes.select(
        key,
        (F.array_position("votes", F.array_max("votes")) - 1).cast("int").alias("prediction"),
        F.round(p, 4).alias("probability"),
        risk_level(p).alias("risk_level"),
        F.round(confidence(p, accuracy), 4).alias("confidence"),
        F.lit(version).alias("model_version"),
        "votes",
    )
    missing = rows.where(~F.coalesce(known, F.lit(False))).select(named(key))
    return results.unionByName(missing, allowMissingColumns=True)


def importances(nodes: DataFrame, features: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """(feature, importance) in falling order: the mean share of each feature in the gains of a tree."""
    gains = nodes.filter("feature IS NOT NULL").groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
    share = F.col("gain") / F.sum("gain").over(Window.partitionBy("tree"))
    found = gains.withColumn("share", share).groupBy("feature").agg(F.sum("share").alias("share"))
    every = nodes.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    whole = found.agg(F.sum("share")).scalar()
    joined = every.join(found, "feature", "left")
    return joined.select("feature", F.coalesce(F.col("share") / whole, F.lit(0.0)).alias("importance")).orderBy(F.desc("importance"), "feature")
