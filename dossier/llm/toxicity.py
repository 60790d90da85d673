"""Toxicity by a factorization machine over hashed terms.

The machine adds a weight for each term and an inner product for each two terms of a text, so a pair such as an insult
with a mention of a group counts for more, or less, than both alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import cut, spread
from dossier.llm.word_tokens import by_bytes

#: Hash buckets of terms.
BUCKETS = 1 << 20
#: Labelled rows that a machine is fitted on at most: those first in the order of their ids' hashes.
SAMPLE_ROWS = 20_000
#: Buckets that the machine knows at most for what they say alone: those whose share differs most between the classes.
KNOWN = 8_192
#: Standard errors by which it has to differ.
LEAST_Z = 4.0
#: The most frequent buckets of the sample, which the machine knows whatever they say alone, for their pairs.
FREQUENT = 500
#: Terms that most rows have are kept as columns of a matrix in training, the rest as lists.
_COLUMNS = 512
#: Bytes of texts that are scored at once; a longer text is alone.
PART_BYTES = 4 << 20
FACTORS = 4
#: Of a word, its beginnings of so many characters are terms too, as compounds and inflected forms share them.
BEGINNINGS = (4, 5, 6, 7)
FOLDS = 5
_EDGES = ".,;:!?\"'()[]{}|*%$#&<>"
_REMEMBER = 200_000


def word_terms(word: str) -> list[int]:
    """Buckets of a lower-cased word without the marks at its edges: itself and its beginnings."""
    word = word.strip(_EDGES)
    if not word:
        return []
    terms = [zlib.crc32(word.encode()) % BUCKETS]
    terms.extend(zlib.crc32(word[:n].encode(), n) % BUCKETS for n in BEGINNINGS if len(word) >= n)
    return terms


def text_words(text: str | None) -> set[str]:
    return set(text.lower().split()) if text else set()


def held_out(doc_id: Column) -> Column:
    """Whether a row is in the fold that labels are never learnt from; a null doc_id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass(frozen=True)
class Machine:
    """terms: known buckets, sorted; bias, weights and factors of the machine over them."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """places: known terms of texts in a row, counts of them each."""
        out = np.full(len(counts), self.bias)
        full = np.flatnonzero(counts)
        if len(full):
            firsts = np.cumsum(counts[full]) - counts[full]
            v = self.factors[places]
            out[full] += np.add.reduceat(self.weights[places], firsts)
            out[full] += 0.5 * (np.add.reduceat(v, firsts) ** 2 - np.add.reduceat(v * v, firsts)).sum(1)
        return out


class Scorer:
    """Scores texts in a task; remembers what it knows of recent words."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.place = {term: place for place, term in enumerate(machine.terms.tolist())}
        self.words: dict[str, bytes] = {}

    def __call__(self, texts: pa.Array) -> np.ndarray:
        found = []
        for text in texts.to_pylist():
            words = text_words(text)
            if len(self.words) > _REMEMBER:
                self.words = {}
            for word in words.difference(self.words):
                known = [self.place[term] for term in word_terms(word) if term in self.place]
                self.words[word] = np.array(known, np.int32).tobytes() if known else b""
            found.append(np.unique(np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int32)))
        counts = np.array([len(x) for x in found])
        margins = self.machine.margins(np.concatenate(found) if found else np.zeros(0, np.int32), counts)
        return 1 / (1 + np.exp(-np.clip(margins, -30, 30)))


def fit_machine(terms: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, steps: int = 200, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Fits by Adam on the mean logistic loss of all rows. rows: places of the known terms of each."""
    prior = (labels.sum() + 0.5) / (len(labels) + 1)
    n, rng = len(terms), np.random.default_rng(seed)
    w = np.zeros((n, FACTORS + 1))
    w[:, 1:] = rng.normal(0, 0.05, (n, FACTORS))
    bias = np.array([np.log(prior / (1 - prior))])
    counts = np.array([len(r) for r in rows])
    if not n or not len(labels) or labels.min() == labels.max() or not counts.sum():
        return Machine(terms[:0], float(bias[0]), np.zeros(0), np.zeros((0, FACTORS)))
    often = np.bincount(np.concatenate(rows), minlength=n)
    columns = np.argsort(-often, kind="stable")[:_COLUMNS]
    columns = np.sort(columns[often[columns] * 20 > len(rows)])
    column_of = np.full(n, -1)
    column_of[columns] = np.arange(len(columns))
    dense = np.zeros((len(rows), len(columns)), np.float32)
    for k, row in enumerate(rows):
        dense[k, column_of[row][column_of[row] >= 0]] = 1
    rows = [row[column_of[row] < 0] for row in rows]
    counts = np.array([len(r) for r in rows])
    places, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), counts)
    full = np.flatnonzero(counts)
    firsts = np.cumsum(counts[full]) - counts[full]
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, bias)]
    balance = np.where(labels == 1, (len(labels) / max(1, labels.sum())) ** 0.5, 1.0)
    for step in range(1, steps + 1):
        v, own = w[places], w[columns].astype(np.float32)
        linear_and_sums = (dense @ own).astype(float)
        squares = (dense @ (own[:, 1:] ** 2)).sum(1).astype(float)
        if len(full):
            linear_and_sums[full] += np.add.reduceat(v, firsts)
            squares[full] += np.add.reduceat(v[:, 1:] ** 2, firsts).sum(1)
        sums = linear_and_sums[:, 1:]
        margin = bias[0] + linear_and_sums[:, 0] + 0.5 * ((sums**2).sum(1) - squares)
        error = balance * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) / len(labels)
        each = error[owner]
        grad = np.empty_like(w)
        grad[:, 0] = np.bincount(places, each, n)
        for f in range(FACTORS):
            grad[:, f + 1] = np.bincount(places, each * (sums[owner, f] - v[:, f + 1]), n)
        by_column = dense.T @ np.column_stack([error, error[:, None] * sums]).astype(np.float32)
        grad[columns] = by_column
        grad[columns, 1:] -= w[columns, 1:] * by_column[:, :1]
        for x, g, (m, s) in ((w, grad + decay * w, state[0]), (bias, np.array([error.sum()]), state[1])):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Machine(terms, float(bias[0]), w[:, 0].copy(), w[:, 1:].copy())


def train_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, known: int = KNOWN, frequent: int = FREQUENT) -> Machine:
    """A machine learnt from the labelled rows (doc_id, toxic) outside the held-out fold.

    Only texts are inputs. At most sample_rows rows are used, one of each doc_id, whatever the corpus: their terms are
    counted by class in Spark, and only the rows' known terms come to the driver. Terms are known if their share differs between the classes
    or if they are among the most frequent ones: a common word that says nothing alone may do so with another.
    Repeated labels of a doc_id count as toxic if one is; null labels and null ids are left out; of documents that share
    a doc_id the one whose text has the least hash is used; other columns are ignored. With one class or none, or without documents, the machine
    is a constant.
    """
    fold = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    chosen = fold.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, PART_BYTES):
                rows = [sorted({t for word in text_words(text) for t in word_terms(word)}) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(rows, pa.list_(pa.int32()))], names=["toxic", "id", "th", "terms"])

    picked = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("toxic", "text", "_id", F.xxhash64("text").alias("th"))
    termed = picked.mapInArrow(terms, "toxic int, id long, th long, terms array<int>")
    # The join may meet any number of rows of one id; map-side sums leave one.
    sample = cut(termed.groupBy("id").agg(F.min(F.struct("th", "toxic", "terms")).alias("one")).select("id", "one.toxic", "one.terms"), "toxic-sample")
    n, n1 = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or not n1 or n1 == n:
        return fit_machine(np.zeros(0, np.int64), [], np.full(max(1, n), 1.0 if n1 else 0.0))
    rate = F.col("n") / n
    z = F.abs(F.col("n1") / n1 - (F.col("n") - F.col("n1")) / (n - n1)) / F.sqrt(rate * (1 - rate) * (1 / n1 + 1 / (n - n1)))
    counted = sample.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("n1"))
    counted = cut(counted.filter(f"n >= 3 and n < {n}").withColumn("z", z).select("term", "n", "z"), "toxic-terms")
    best = counted.filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(known)
    best = best.unionByName(counted.orderBy(F.desc("n"), "term").limit(frequent)).select("term").distinct()
    found = np.array(sorted(r.term for r in best.collect()), np.int64)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.flatnonzero(np.isin(found, row, assume_unique=True)).tolist() for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int32()))], names=["id", "toxic", "places"])

    rows = sample.select("id", "toxic", "terms").mapInArrow(places, "id long, toxic int, places array<int>").toArrow().sort_by("id")
    labels_of = rows.column("toxic").to_numpy().astype(float)
    return fit_machine(found, [np.array(r, np.int64) for r in rows.column("places").to_pylist()], labels_of)


def score_toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score, from 0 to 1, of every row of docs (doc_id, text); other columns are ignored.

    A text without known terms, be it null or empty, scores as the bias alone. A text may be of any length; repeated
    rows score alike, each for itself. No documents: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in by_bytes(batch, 1, PART_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer(part.column(1)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")


def drop_toxic(docs: DataFrame, machine: Machine, limit: float = 0.5) -> DataFrame:
    """docs without the rows that score at or above the limit, whatever their doc_id; null and empty texts score as in
    score_toxicity(). All columns stay as they are. A machine that has learnt no terms, as it saw one class or none, drops
    nothing."""
    if not len(machine.terms):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in by_bytes(batch, batch.schema.get_field_index("text"), PART_BYTES):
                yield part.filter(pc.less(pa.array(scorer(part.column("text"))), limit))

    return docs.mapInArrow(keep, docs.schema)


def op3_toxicity_scores(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    scores = score_toxicity(docs, train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
