"""Training a scorer for candidate edges on balanced splits.

Neighbour means of one and two steps are computed once by Spark for each view;
the edge classifier is then fitted on them in short rounds, each continuing
from the weights of the last, with the best round by validation loss kept.

A round reads the edges several times. They are packed into matrices once and
kept by the executors; a reading multiplies them with the weights and gives one
row of sums per partition.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinedge.operators.embed import narrow_mean, packed_edges
from twinedge.operators.labels import expand_copies
from twinedge.operators.metrics import bce_term, confusion_counts, hit_term
from twinedge.schema import CUT_THRESHOLD, EARLY_STOPPING, EPOCHS, HIDDEN_WIDTH, VIEWS
from twinedge.scratch import materialise
from twinedge.sources.runs import RunState, RunStore
from twinedge.sources.store import save_model, write_model


def _as_vectors(features: DataFrame) -> DataFrame:
    return features.select("idx", array_to_vector(F.col("vec").cast("array<double>")).alias("v"))


def fit_reducer(features: DataFrame, width: int) -> PipelineModel:
    """Principal components of the node vectors ``(idx, vec)`` on a common scale."""
    stages = [
        PCA(k=width, inputCol="v", outputCol="p"),
        StandardScaler(withMean=True, inputCol="p", outputCol="s"),
    ]
    return Pipeline(stages=stages).fit(_as_vectors(features))


def reduced_features(reducer: PipelineModel, features: DataFrame) -> DataFrame:
    return reducer.transform(_as_vectors(features)).select("idx", vector_to_array("s").alias("vec"))


def propagated_features(views: DataFrame, features: DataFrame, width: int) -> DataFrame:
    """``(idx, vec)``: own vector, then the means of one and of two steps for
    each view. A node gathers 9 short vectors, whatever its degree."""
    order = {v: k for k, v in enumerate(VIEWS)}
    place = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("view"))
    views = views.select(place.alias("view"), "src", "dst", "w")
    views = packed_edges(views, width) or views  # once for both means
    one = materialise(narrow_mean(views, features, width), "mean-1")
    two = narrow_mean(views, one, width)
    slots = reduce(
        DataFrame.unionByName,
        [
            features.select("idx", F.lit(0).alias("slot"), "vec"),
            one.select("idx", (F.col("view") * 2 + 1).alias("slot"), "vec"),
            two.select("idx", (F.col("view") * 2 + 2).alias("slot"), "vec"),
        ],
    )
    parts = F.sort_array(F.collect_list(F.struct("slot", "vec")))
    return slots.groupBy("idx").agg(F.flatten(F.transform(parts, lambda p: p["vec"])).alias("vec"))


def edge_vectors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with ``features``: the vectors of source and destination."""
    return _for_model(_edge_arrays(edges, nodes))


def _edge_arrays(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """:func:`edge_vectors` with plain arrays, which are read and written faster."""
    at_src = nodes.select(F.col("idx").alias("src"), F.col("vec").alias("_a"))
    at_dst = nodes.select(F.col("idx").alias("dst"), F.col("vec").alias("_b"))
    both = edges.join(at_src, "src").join(at_dst, "dst")
    return both.withColumn("features", F.concat("_a", "_b")).drop("_a", "_b")


def _is_array(vectors: DataFrame) -> bool:
    return isinstance(vectors.schema["features"].dataType, T.ArrayType)


def _for_model(vectors: DataFrame) -> DataFrame:
    """``vectors`` with ``features`` in the form that the classifier takes."""
    return vectors.withColumn("features", array_to_vector("features")) if _is_array(vectors) else vectors


@dataclass
class TrainedScorer:
    """The best model of a run."""

    root: str
    run_id: str
    model_path: str

    def run(self, spark: SparkSession) -> RunStore:
        return RunStore(spark, self.root, self.run_id)

    def metrics(self, spark: SparkSession) -> DataFrame:
        return self.run(spark).metrics()

    def model(self) -> MultilayerPerceptronClassificationModel:
        return MultilayerPerceptronClassificationModel.load(self.model_path)


def stored_scorer(spark: SparkSession, root: str, run_id: str) -> TrainedScorer:
    """The scorer of a run that was trained before."""
    path = RunStore(spark, root, run_id).best_model()
    if path is None:
        raise FileNotFoundError(f"no trained scorer of run {run_id} in {root}")
    return TrainedScorer(root, run_id, path)


def with_scores(model: MultilayerPerceptronClassificationModel, edges: DataFrame) -> DataFrame:
    """Score every edge: probability of label 1."""
    scored = model.transform(edges)
    return scored.withColumn("score", F.element_at(vector_to_array("probability"), 2)).drop(
        "rawPrediction", "probability", "prediction"
    )


PACKED_ROWS = 1024
"""Rows of a matrix of :func:`packed`."""


def packed(vectors: DataFrame, width: int) -> RDD:
    """``(split, labels, rows)``: the rows of ``vectors(split, label, features)``
    as matrices of at most ``PACKED_ROWS`` rows of ``width`` float32, by split.

    An RDD, as its kept form is what a reading hands to Python; a kept table would
    be converted each time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            splits = np.array(batch.column("split").to_pylist(), dtype=object)
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            if not np.isin(labels, (0.0, 1.0)).all():
                raise ValueError("labels must be 0 or 1")
            lengths = pc.list_value_length(batch.column("vec")).to_numpy(zero_copy_only=False)
            if not (lengths == width).all():
                raise ValueError(f"every vector must hold {width} numbers")
            # made float32 here: Spark's cast of an array is slow
            rows = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(labels), width)
            for split in sorted(set(splits)):
                own = np.flatnonzero(splits == split)
                for at in range(0, len(own), PACKED_ROWS):
                    taken = own[at : at + PACKED_ROWS]
                    cells = [split], [labels[taken].astype(np.int8).tobytes()], [rows[taken].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["split", "labels", "rows"])

    numbers = F.col("features") if _is_array(vectors) else vector_to_array("features", "float32")
    plain = vectors.select("split", F.col("label").cast("double").alias("label"), numbers.alias("vec"))
    return plain.mapInArrow(run, "split string, labels binary, rows binary").rdd.map(tuple)


@dataclass
class PackedEdges:
    """What training reads of ``vectors(split, label, features)``, kept by the
    executors until :meth:`release`. Several runs may read it."""

    spark: SparkSession
    width: int
    blocks: RDD

    @classmethod
    def of(cls, vectors: DataFrame) -> PackedEdges:
        width = len(vectors.select("features").first()["features"])
        blocks = packed(vectors.where("split <> 'test'"), width).persist(StorageLevel.MEMORY_AND_DISK)
        return cls(vectors.sparkSession, width, blocks)

    def release(self) -> None:
        self.blocks.unpersist()


def _layers(weights: np.ndarray, width: int, hidden: int) -> list[np.ndarray]:
    """Matrix and bias of both layers, as the classifier's weights hold them."""
    cuts = np.cumsum([width * hidden, hidden, hidden * 2])
    first, bias, second, last = np.split(weights, cuts)
    return [first.reshape(width, hidden), bias, second.reshape(hidden, 2), last]


def _sums(x: np.ndarray, y: np.ndarray, layers: list[np.ndarray]) -> tuple[float, int, np.ndarray]:
    """Cross-entropy (logarithms cut at -100), hits and gradient, summed over rows."""
    first, bias, second, last = layers
    with np.errstate(over="ignore"):
        h = 1.0 / (1.0 + np.exp(-(x @ first + bias)))
        z = h @ second + last
        margin = np.where(y == 1, z[:, 1] - z[:, 0], z[:, 0] - z[:, 1])
        loss = np.minimum(np.logaddexp(0.0, -margin), 100.0).sum()
        p = 1.0 / (1.0 + np.exp(z[:, 0] - z[:, 1]))
    error = np.stack([y - p, p - y], axis=1)
    back = (error @ second.T) * h * (1.0 - h)
    parts = x.T @ back, back.sum(axis=0), h.T @ error, error.sum(axis=0)
    return float(loss), int((np.rint(p) == y).sum()), np.concatenate([q.ravel() for q in parts])


def edge_sums(
    blocks: RDD, splits: tuple[str, ...], weights: np.ndarray, width: int, hidden: int
) -> dict[str, tuple[int, float, int, np.ndarray]]:
    """Rows, loss, hits and gradient, summed over the ``blocks`` of each split."""

    def add(found: dict[str, tuple], split: str, sums: tuple) -> None:
        found[split] = tuple(a + b for a, b in zip(found[split], sums)) if split in found else sums

    def run(part: Iterator[tuple]) -> Iterator[tuple]:
        layers = _layers(weights, width, hidden)
        found: dict[str, tuple] = {}
        for split, labels, rows in part:
            if split in splits:
                y = np.frombuffer(labels, np.int8).astype(np.float64)
                x = np.frombuffer(rows, np.float32).reshape(len(y), width).astype(np.float64)
                add(found, split, (len(y), *_sums(x, y, layers)))
        return iter(found.items())

    totals: dict[str, tuple] = {}
    # a row per split and partition, each as large as the weights; in the order of
    # the partitions, so that a run can be repeated
    for split, sums in blocks.mapPartitions(run).collect():
        add(totals, split, sums)
    return totals


def descend(cost: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, iterations: int, kept: int = 10, tries: int = 20) -> np.ndarray:
    """L-BFGS from ``start`` with steps that meet the weak Wolfe conditions."""
    w, (f, g) = start, cost(start)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        d, shares = -g, []
        for s, y in reversed(steps):
            shares.append((s @ d) / (s @ y))
            d = d - shares[-1] * y
        if steps:
            s, y = steps[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), share in zip(steps, reversed(shares)):
            d = d + (share - (y @ d) / (s @ y)) * s
        slope = g @ d
        if not slope < 0:
            break
        lo, hi, t = 0.0, math.inf, 1.0 if steps else min(1.0, 1.0 / np.linalg.norm(d))
        best = None  # the lowest point met
        for _ in range(tries):
            there = cost(w + t * d)
            low_enough = there[0] <= f + 1e-4 * t * slope
            if low_enough and (best is None or there[0] <= best[1]):
                best = t, *there
            if not low_enough:
                hi = t
            elif there[1] @ d < 0.9 * slope:
                lo = t
            else:
                break
            t = (lo + hi) / 2 if hi < math.inf else 2 * lo
        if best is None:
            break
        t, reached, at = best
        if (t * d) @ (at - g) > 0:
            steps = [*steps, (t * d, at - g)][-kept:]
        w, f, g = w + t * d, reached, at
    return w


def scorer_of(spark: SparkSession, width: int, hidden: int, weights: np.ndarray | None = None, seed: int | None = None) -> MultilayerPerceptronClassificationModel:
    """The classifier with given weights, or with those it starts from."""
    trainer = MultilayerPerceptronClassifier(layers=[width, hidden, 2], maxIter=0, seed=seed)
    if weights is not None:
        trainer = trainer.setInitialWeights(Vectors.dense(weights))
    row = spark.createDataFrame([(0.0, Vectors.dense([0.0] * width))], ["label", "features"])
    return trainer.fit(row.coalesce(1))


def train_edge_scorer(
    vectors: DataFrame | PackedEdges,
    root: str,
    run_id: str,
    hidden: int = HIDDEN_WIDTH,
    rounds: int = EPOCHS,
    iterations: int = 5,
    patience: int = EARLY_STOPPING,
    seed: int = 1234,
) -> TrainedScorer:
    """Fit on split ``train``, keep the best model by the loss on ``valid``.

    ``vectors(split, label, features)`` is read once, or not at all if it was
    packed before. The best round
    has the smallest loss, the latest of equals; training ends when
    ``patience - 1`` rounds have passed since the best one. Every round is
    committed to the run's folder; a run that exists goes on after its last
    committed round, with that round's weights and the losses so far.
    """
    if not isinstance(vectors, PackedEdges):
        edges = PackedEdges.of(vectors)
        try:
            return train_edge_scorer(edges, root, run_id, hidden, rounds, iterations, patience, seed)
        finally:
            edges.release()
    spark, width, blocks = vectors.spark, vectors.width, vectors.blocks
    run = RunStore(spark, root, run_id)
    state = run.latest() or RunState(0, 0, [])
    read: dict[bytes, tuple] = {}  # sums over split 'train' by the weights of a round's readings

    def fitted(weights: np.ndarray) -> tuple:
        key = weights.tobytes()
        if key not in read:
            found = edge_sums(blocks, ("train",), weights, width, hidden)
            if "train" not in found:
                raise ValueError("split 'train' is empty: there is nothing to fit on")
            read[key] = found["train"]
        return read[key]

    def cost(weights: np.ndarray) -> tuple[float, np.ndarray]:
        n, loss, _hits, slope = fitted(weights)
        return loss / n, slope / n

    weights = np.array(state.weights) if state.round else None
    while state.round < rounds and not (state.round and state.round - state.best_round >= patience - 1):
        if weights is None:
            weights = scorer_of(spark, width, hidden, seed=seed).weights.toArray()
        weights = descend(cost, weights, iterations)
        # the descent has read split 'train' with these weights, and the next one begins there
        by_split = {"train": fitted(weights)} | edge_sums(blocks, ("valid",), weights, width, hidden)
        read = {weights.tobytes(): by_split["train"]}
        round_no = state.round + 1
        found = [
            (round_no, split, metric, value)
            for split, (n, loss, hits, _) in sorted(by_split.items())
            for metric, value in (("loss", loss / n), ("accuracy", 100.0 * hits / n))
        ]
        state = RunState(round_no, state.best_round, weights.tolist(), [*state.history, *found])
        losses = state.losses()
        if round_no not in losses:
            raise ValueError("split 'valid' is empty: there is nothing to choose a round by")
        if math.isnan(losses[round_no]):
            raise ValueError(f"the loss on split 'valid' is not a number in round {round_no}")
        state.best_round = min(losses, key=lambda n: (losses[n], -n))
        if state.best_round == round_no:
            # before the commit that names it; the older ones go after it
            model = scorer_of(spark, width, hidden, weights)
            write_model(model, run.models, round_no)
        run.commit(state)
        if state.best_round == round_no:
            save_model(spark, model, run.models, round_no, written=True)
    return stored_scorer(spark, root, run_id)


def evaluation(scored: DataFrame, threshold: float = CUT_THRESHOLD) -> DataFrame:
    """``(metric, value)`` of ``scored(label, score)``: loss, accuracy in percent
    and the four confusion cells."""
    loss = scored.agg(F.avg(bce_term()).alias("loss"), (F.avg(hit_term()) * 100).alias("accuracy"))
    cells = confusion_counts(scored, threshold)

    def long(row: DataFrame) -> DataFrame:
        values = row.select([F.col(c).cast("double").alias(c) for c in row.columns])
        return values.unpivot([], values.columns, "metric", "value")

    return long(loss).unionByName(long(cells))


def evaluate_edge_scorer(trained: TrainedScorer, vectors: DataFrame, threshold: float = CUT_THRESHOLD) -> DataFrame:
    """:func:`evaluation` of the best model on split ``test``."""
    scored = with_scores(trained.model(), _for_model(vectors.where("split = 'test'"))).select("label", "score")
    return evaluation(materialise(scored, "test-scores"), threshold)


def node_vectors(views: DataFrame, features: DataFrame, reducer: PipelineModel) -> DataFrame:
    """``(idx, vec)``: what the classifier sees of a node."""
    width = reducer.stages[0].getK()
    return propagated_features(views, materialise(reduced_features(reducer, features), "reduced"), width)


def training_vectors(splits: DataFrame, nodes: DataFrame) -> DataFrame:
    """The written-down training table ``(split, label, src, dst, features)``, with arrays."""
    return materialise(_edge_arrays(expand_copies(splits), nodes), "training-vectors")
