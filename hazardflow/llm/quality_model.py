"""Quality scores: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has a core (its letters, lower-case) and a shape (its pattern of cases, digits and
signs). Cores and shapes of the labelled sample get sparse ternary index vectors; the vector of
each is its own index vector plus those of its neighbours, summed over the sample. A document is
the mean of its core vectors, the mean of its shape vectors, the shares of words that repeat the
word before, of distinct words and of unknown cores, and the logarithm of its length. A two-layer numpy network gives a logit; a temperature fitted on rows that
the network was not trained on calibrates the probability.

The fit is bounded: at most FIT_ROWS labelled documents, MAX_CORES cores and MAX_SHAPES shapes of
at most MAX_BYTES bytes. Vocabulary and neighbour sums are Spark jobs over whole texts of the
sample; only matrices of bounded size reach the driver. Scoring is one pass over all whole texts,
with the model (about 3 MB) as a closure.

Edge cases: null and empty texts get the score of a document without words; null labels are no
labels; repeated labels count once (the larger); without any label every score is 0.5; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardflow.llm.common import no_cycles, plain_bytes, settle, sliced
from hazardflow.llm.text_metrics import words_of
from hazardflow.session import written

FIT_ROWS = 12_000
MAX_CORES = 8192
MAX_SHAPES = 1024
MAX_BYTES = 32
SIZE = 32
SIGNS = 4
REACH = 2
HIDDEN = 32
EXTRA = 4
ROUNDS = 300
MAX_WORDS = 150_000
FIT_PARTS = 8
UPPER, LOWER, DIGIT, RUN = re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+"), re.compile(r"([^\w\s])\1+")
LETTERS = re.compile(r"[\W\d_]+")


def core_and_shape(word: bytes) -> tuple[bytes, bytes]:
    text = word.decode()
    shape = RUN.sub(r"\1\1", DIGIT.sub("0", UPPER.sub("A", LOWER.sub("a", text))))
    return LETTERS.sub("", text).lower().encode(), shape.encode()


class Vocabulary:
    """Numbers of cores (from 1) and shapes (after them); 0 is unknown."""

    def __init__(self, cores: list[bytes], shapes: list[bytes]):
        self.cores = {w: i for i, w in enumerate(cores, 1)}
        self.shapes = {w: i for i, w in enumerate(shapes, 1 + len(cores))}
        self.size = 1 + len(cores) + len(shapes)
        self.known: dict[bytes, tuple[int, int]] = {}

    def codes(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Core and shape number of each word, and a number that only equal words share."""
        with no_cycles():
            coded = words.dictionary_encode()
            keys = plain_bytes(coded.dictionary)
            if len(self.known) > MAX_WORDS:
                self.known = {}
            for key in keys:
                if key not in self.known:
                    core, shape = core_and_shape(key)
                    self.known[key] = (self.cores.get(core, 0), self.shapes.get(shape, 0))
            pairs = np.array([self.known[k] for k in keys], np.int64).reshape(-1, 2)
        same = coded.indices.to_numpy()
        return pairs[same], same

    def index_vectors(self) -> np.ndarray:
        import xxhash

        out = np.zeros((self.size, SIZE), np.float32)
        for kind, words in ((b"c", self.cores), (b"s", self.shapes)):
            for word, i in words.items():
                dice = np.random.default_rng(xxhash.xxh64_intdigest(kind + word))
                out[i, dice.choice(SIZE, SIGNS, replace=False)] = dice.choice([-1.0, 1.0], SIGNS)
        return out


def pooled(vocabulary: Vocabulary, vectors: np.ndarray, texts: pa.Array) -> np.ndarray:
    """The features of each text."""
    n = len(texts)
    words, owner = words_of(texts)
    codes, same = vocabulary.codes(words)
    count = np.bincount(owner, minlength=n)
    out = np.zeros((n, 2 * SIZE + EXTRA), np.float32)
    known = np.bincount(owner, codes[:, 0] > 0, n)
    present = np.flatnonzero(count)
    starts = (np.cumsum(count) - count)[present]
    if len(present):
        for side in (0, 1):
            out[present, side * SIZE : (side + 1) * SIZE] = np.add.reduceat(vectors[codes[:, side]], starts, axis=0)
    out[:, :SIZE] /= np.maximum(known, 1)[:, None]
    out[:, SIZE : 2 * SIZE] /= np.maximum(count, 1)[:, None]
    again = (same[1:] == same[:-1]) & (owner[1:] == owner[:-1])
    distinct = np.unique(owner.astype(np.int64) * (len(same) + 1) + same) // (len(same) + 1)
    out[:, -4] = np.bincount(owner[1:][again], minlength=n) / np.maximum(count, 1)
    out[:, -3] = np.bincount(distinct, minlength=n) / np.maximum(count, 1)
    out[:, -2] = 1 - known / np.maximum(count, 1)
    out[:, -1] = np.log1p(count)
    return out


@dataclass
class QualityModel:
    vocabulary: Vocabulary
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        features = (pooled(self.vocabulary, self.vectors, texts) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(logits(self.weights, features) / self.temperature, -30, 30)))


def logits(weights: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    inner, bias, outer, last = weights
    return np.tanh(x @ inner + bias) @ outer + last[0]


def train(x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Weights by full-batch Adam on four fifths of the rows, temperature on the rest."""
    dice = np.random.default_rng(7)
    rest = dice.random(len(y)) < 0.2
    if rest.all() or not rest.any():
        rest = np.arange(len(y)) % 2 == 1
    tx, ty = (x[~rest], y[~rest]) if (~rest).any() else (x, y)
    weights = [dice.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), dice.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, ROUNDS + 1):
        hidden = np.tanh(tx @ weights[0] + weights[1])
        error = (1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3][0], -30, 30))) - ty) / len(ty)
        back = np.outer(error, weights[2]) * (1 - hidden**2)
        slopes = [tx.T @ back + 1e-4 * weights[0], back.sum(0), hidden.T @ error + 1e-4 * weights[2], np.array([error.sum()])]
        for w, g, a, b in zip(weights, slopes, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            w -= 0.02 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    z, t = logits(weights, x[rest]), y[rest]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 71))
    loss = [np.mean(np.logaddexp(0, z / g) - t * z / g) for g in grid] if len(t) else [0.0]
    return weights, float(grid[int(np.argmin(loss))]) if len(t) else 1.0


def labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, text, y of at most `rows` labelled documents outside the held-out fifth, by hash order."""
    usable = labels.filter("quality is not null and doc_id is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    picked = usable.groupBy("doc_id").agg(F.max("quality").cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> QualityModel | None:
    sample = written(labelled(docs, labels, rows), "fit")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            seen: Counter = Counter()
            found = pc.value_counts(words_of(batch.column(0))[0])
            for key, n in zip(plain_bytes(found.field("values")), found.field("counts").to_pylist(), strict=True):
                core, shape = core_and_shape(key)
                seen[0, core] += n
                seen[1, shape] += n
            kinds, keys = [k[0] for k in seen], [k[1] for k in seen]
            yield pa.record_batch([pa.array(kinds, pa.int32()), pa.array(keys, pa.binary()), pa.array(list(seen.values()), pa.int64())], ["kind", "word", "n"])

    counts = sample.select("text").mapInArrow(count, "kind int, word binary, n long").groupBy("kind", "word").agg(F.sum("n").alias("n"))
    counts = written(counts.filter(f"length(word) between 1 and {MAX_BYTES}"), "words")

    def commonest(kind: int, most: int) -> list[bytes]:
        top = counts.filter(F.col("kind") == kind).orderBy(F.desc("n"), "word").limit(most)
        return [bytes(r["word"]) for r in top.collect()]

    vocabulary = Vocabulary(commonest(0, MAX_CORES), commonest(1, MAX_SHAPES))
    own = vocabulary.index_vectors()

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((vocabulary.size, SIZE), np.float32)
        for batch in sliced(batches, 1 << 20):
            words, owner = words_of(batch.column(0))
            codes, _ = vocabulary.codes(words)
            both = own[codes[:, 0]] + own[codes[:, 1]]
            for reach in range(1, min(REACH, len(words) - 1) + 1):
                near = owner[:-reach] == owner[reach:]
                for here, there in ((codes[:-reach], both[reach:]), (codes[reach:], both[:-reach])):
                    for side in (0, 1):
                        who, what = here[near, side], there[near]
                        if len(who):
                            order = np.argsort(who, kind="stable")
                            first = np.flatnonzero(np.concatenate([[True], np.diff(who[order]) > 0]))
                            total[who[order][first]] += np.add.reduceat(what[order], first, axis=0)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])

    vectors = own.astype(np.float64)
    for row in sample.select("text").coalesce(FIT_PARTS).mapInArrow(neighbours, "sums binary").collect():  # one matrix a part
        vectors += np.frombuffer(row["sums"], np.float32).reshape(vectors.shape)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    vectors[0] = 0
    vectors = vectors.astype(np.float32)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1 << 20):
            rows = pooled(vocabulary, vectors, batch.column(1))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "y", "features"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    known = sample.select("doc_id", "y", "text").select("doc_id", "text", "y")
    rows = known.mapInArrow(features, f"doc_id {kind}, y double, features binary").orderBy("doc_id").toArrow()
    if not rows.num_rows:
        return None
    x = np.frombuffer(b"".join(rows["features"].to_pylist()), np.float32).reshape(rows.num_rows, -1).astype(np.float64)
    centre, scale = x.mean(0), x.std(0) + 1e-3
    weights, temperature = train((x - centre) / scale, rows["y"].to_numpy())
    return QualityModel(vocabulary, vectors, centre, scale, weights, temperature)


def score_column(model: QualityModel | None, text: str = "text") -> Column:
    """The score of each text, 0 to 1."""
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model.vocabulary.known = {}
        for texts in batches:
            step = max(1, len(texts) * (1 << 20) // max(texts.nbytes, 1))
            parts = [model.scores(texts.slice(i, step)) for i in range(0, len(texts), step)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())
        model.vocabulary.known = {}
        settle()

    return score(text)


def scored(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fit(docs, labels)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = docs.select("doc_id", held_out.alias("held_out"), score_column(model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
