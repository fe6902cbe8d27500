"""Neighbourhood features, view attention and edge scoring.

Spark moves the vectors and sums few of them; many are summed by packed edges
(:mod:`twinedge.operators.parts`). Weight matrices, whose size depends on the model
and not on the data, are multiplied with Arrow batches. Because the neighbour mean
is linear, vectors are projected to the hidden width before they are moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinedge.operators.parts import EdgeParts, edge_counts
from twinedge.schema import VIEWS
from twinedge.scratch import discard, materialise


# ---- weights -------------------------------------------------------------

@dataclass(frozen=True)
class Linear:
    weight: np.ndarray  # (out, in)
    bias: np.ndarray  # (out,)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight.T + self.bias


@dataclass(frozen=True)
class SageLayer:
    own: Linear
    near: Linear  # its bias is zero


@dataclass(frozen=True)
class ScorerWeights:
    layers: Mapping[str, tuple[SageLayer, SageLayer]]  # by view
    attention: Mapping[str, Linear]  # by view, one output each
    hidden: Linear  # (h, 2h)
    output: Linear  # (1, h)

    @property
    def width(self) -> int:
        return self.output.weight.shape[1]


def formula_weights(inputs: int, width: int) -> ScorerWeights:
    """Weights from a closed formula, for scoring without a trained model."""

    def linear(rows: int, cols: int, shift: int) -> Linear:
        cell = np.arange(rows * cols, dtype=np.float64).reshape(rows, cols) + shift
        return Linear(np.sin(cell) / np.sqrt(rows), np.cos(np.arange(rows) + shift) / rows)

    def plain(rows: int, cols: int, shift: int) -> Linear:
        return Linear(linear(rows, cols, shift).weight, np.zeros(rows))

    def layer(cols: int, shift: int) -> SageLayer:
        return SageLayer(linear(width, cols, shift), plain(width, cols, shift + 1))

    return ScorerWeights(
        {v: (layer(inputs, 10 * k), layer(width, 10 * k + 5)) for k, v in enumerate(VIEWS)},
        {v: linear(1, width, 100 + k) for k, v in enumerate(VIEWS)},
        linear(width, 2 * width, 200),
        linear(1, width, 300),
    )


WEIGHT_SCHEMA = "name string, rows int, cols int, weight array<double>, bias array<double>"


def _named_linears(weights: ScorerWeights) -> dict[str, Linear]:
    named = {"hidden": weights.hidden, "output": weights.output}
    for view, pair in weights.layers.items():
        for n, layer in enumerate(pair, 1):
            named[f"{view}/conv{n}/own"], named[f"{view}/conv{n}/near"] = layer.own, layer.near
        named[f"{view}/attention"] = weights.attention[view]
    return named


def save_weights(spark: SparkSession, weights: ScorerWeights, path: str) -> None:
    rows = [
        (name, *lin.weight.shape, lin.weight.ravel().tolist(), lin.bias.tolist())
        for name, lin in _named_linears(weights).items()
    ]
    spark.createDataFrame(rows, WEIGHT_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> ScorerWeights:
    """Read the weights of one scorer: a few matrices, whatever the data."""
    lin = {
        r["name"]: Linear(np.array(r["weight"]).reshape(r["rows"], r["cols"]), np.array(r["bias"]))
        for r in spark.read.schema(WEIGHT_SCHEMA).parquet(path).collect()
    }
    return ScorerWeights(
        {
            v: tuple(SageLayer(lin[f"{v}/conv{n}/own"], lin[f"{v}/conv{n}/near"]) for n in (1, 2))
            for v in VIEWS
        },
        {v: lin[f"{v}/attention"] for v in VIEWS},
        lin["hidden"],
        lin["output"],
    )


# ---- Arrow helpers -------------------------------------------------------

def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as a 2-d array."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.astype(np.float32).ravel()))


BLOCK = 64
"""Numbers in a block of a vector, whatever its length."""


def _project(nodes: DataFrame, maps: Mapping[str, Sequence[Callable[[np.ndarray], np.ndarray]]]) -> DataFrame:
    """``(view, idx, v0, v1, ...)``: the maps of each view applied to the vectors
    in one pass.

    ``nodes`` is ``(idx, vec)``, used for every view, or ``(view, idx, vec)``.
    """
    by_view = "view" in nodes.columns
    names = [f"v{k}" for k in range(len(next(iter(maps.values()))))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            views = np.array(batch.column("view").to_pylist()) if by_view else None
            for view, applied in maps.items():
                part = batch.filter(pa.array(views == view)) if by_view else batch
                if part.num_rows == 0:
                    continue
                vectors = _matrix(part.column("vec"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([view] * part.num_rows), part.column("idx"), *[_lists(apply(vectors)) for apply in applied]],
                    ["view", "idx", *names],
                )

    return nodes.mapInArrow(run, ", ".join(["view string", "idx bigint", *[f"{n} array<float>" for n in names]]))


def blocked(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` with one row per block of ``BLOCK`` numbers of ``vec``, numbered
    by ``block``; the last block may be shorter."""
    if _blocks(width) == 1:
        return rows.select(*[c for c in rows.columns if c != "vec"], F.lit(0).alias("block"), "vec")
    parts = F.transform(F.sequence(F.lit(0), F.lit(_blocks(width) - 1)), lambda b: F.slice("vec", b * BLOCK + 1, BLOCK))
    return rows.select(*[c for c in rows.columns if c != "vec"], F.posexplode(parts).alias("block", "vec"))


def assembled(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``(keys, vec)`` from blocks."""
    if _blocks(width) == 1:
        return rows.select(*keys, F.slice("vec", 1, width).alias("vec"))
    parts = F.sort_array(F.collect_list(F.struct("block", "vec")))
    return rows.groupBy(*keys).agg(F.slice(F.flatten(parts["vec"]), 1, width).alias("vec"))


def _blocks(width: int) -> int:
    return max(1, -(-width // BLOCK))


def weighted_sum(rows: DataFrame, keys: list[str], weight: str, width: int, mean: bool = False) -> DataFrame:
    """``(keys, vec)``: sum (or mean) of ``weight * vec`` over the rows of a key."""
    return _summed(blocked(rows, width), keys, weight, width, mean)


def _summed(blocks: DataFrame, keys: list[str], weight: str, width: int, mean: bool, within: Sequence[str] = ()) -> DataFrame:
    """As :func:`weighted_sum`, of rows that are blocked already. ``within`` names
    columns that the key and block determine and the rows are dealt by.

    Each key and block holds a buffer of plain doubles: a hash aggregate in
    generated code that combines map-side and spills, the same for any width.
    """
    w = F.col(weight).cast("double")
    cells = [F.sum(w * F.get("vec", F.lit(i))).alias(f"_{i}") for i in range(min(width, BLOCK))]
    sums = blocks.groupBy(*keys, "block", *within).agg(F.sum(w).alias("_w"), *cells)
    by = F.col("_w") if mean else F.lit(1.0)
    vectors = sums.select(*keys, "block", F.array(*[F.col(f"_{i}") / by for i in range(min(width, BLOCK))]).alias("vec"))
    return assembled(vectors, keys, width)


# ---- layers --------------------------------------------------------------

CELLS = 8
"""Parts that the sums of one layer are made in, each in a task of its own. A
vector travels once to each part that has an end of its edges."""

NARROW = 16
"""Numbers up to which a vector travels along each edge: it is then hardly longer
than an edge's entry in the lists, which take a sort of all edges to make."""

MANY_NUMBERS = 1 << 24
"""Numbers to add up, edges by width, from which the edges are packed by the node
they lead into, so that neither vectors nor sums are shuffled. Below, a join costs
less than packing."""

HUB_ENDS = 1 << 20
"""Ends of one source in a row; a source with more takes several rows."""


def _hubs(edges: DataFrame, on: list[str]) -> DataFrame:
    """``(on, chunks)`` of the sources that take several rows."""
    ends = edges.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB_ENDS)
    return ends.select(*on, F.ceil(F.col("n") / HUB_ENDS).cast("int").alias("chunks"))


def packed_edges(views: DataFrame, width: int) -> EdgeParts | None:
    """The edges ``(view, src, dst, w)`` packed by the node they lead into, where
    they are many. Several means or layers may read them. ``views`` is read twice."""
    counted = edge_counts(views)  # a row per view
    return EdgeParts.of(views, width, counted) if sum(r["edges"] for r in counted) * width >= MANY_NUMBERS else None


def neighbour_mean(views: DataFrame | EdgeParts, features: DataFrame, width: int) -> DataFrame:
    """``(view, idx, vec)``: weighted mean of the vectors at the sources of the
    edges into a node. ``features`` is ``(idx, vec)``, the same for every view,
    or ``(view, idx, vec)``; ``width`` is the length of the vectors. ``views`` is
    read up to three times.

    Many edges are packed; the vectors and the sums are then not shuffled. Fewer are
    joined: the nodes are dealt by a hash to parts, and a vector is sent once to each
    part that its edges lead to, with their other ends, not once along every edge.
    Sums of a part are complete where they are made.
    """
    packed = views if isinstance(views, EdgeParts) else packed_edges(views, width)
    if packed:
        return packed.sums(features, width, mean=True)
    nodes = features.withColumnRenamed("idx", "src")
    on = [c for c in ("view", "src") if c in nodes.columns]
    carried = [c for c in on if c == "view"]  # or else the view is told with each end
    blocks = _blocks(width)
    parts = -(-CELLS // blocks)  # a wide vector's blocks are dealt out as well

    part = F.pmod(F.xxhash64("dst"), F.lit(parts))
    end = F.struct(*[c for c in ("view",) if c not in on], F.col("dst").alias("idx"), "w")
    lists = [F.collect_list(F.when(part == j, end)).alias(f"_{j}") for j in range(parts)]
    by = list(on)
    hubs = materialise(_hubs(views, on), "hub-sources")
    if not hubs.isEmpty():
        chunks = F.coalesce("chunks", F.lit(1))
        views = views.join(hubs, on, "left").withColumn("chunk", F.pmod(F.xxhash64("dst"), chunks))
        by.append("chunk")
    ends = views.groupBy(*by).agg(*lists)
    sent = [F.struct(F.lit(j).alias("part"), F.col(f"_{j}").alias("ends"), "vec") for j in range(parts)]
    filled = F.filter(F.array(*sent), lambda x: F.size(x["ends"]) > 0)
    rows = ends.join(nodes, on).select(*carried, F.explode(filled).alias("x")).select(*carried, "x.*")
    dealt = blocked(rows, width).withColumn("cell", F.col("part") * blocks + F.col("block"))
    messages = dealt.repartitionById(parts * blocks, "cell").select(*carried, "cell", "block", "vec", F.inline("ends"))
    return _summed(messages, ["view", "idx"], "w", width, mean=True, within=["cell"])


def narrow_mean(views: DataFrame | EdgeParts, features: DataFrame, width: int) -> DataFrame:
    """:func:`neighbour_mean` of at most ``NARROW`` numbers, which go along the
    edges where these are few; a wider vector takes the other way."""
    packed = views if isinstance(views, EdgeParts) or width > NARROW else packed_edges(views, width)
    if packed is not None:
        return neighbour_mean(packed, features, width)
    nodes = features.withColumnRenamed("idx", "src")
    # the source first: a sort or a hash by one of few views tells little
    on = [c for c in ("src", "view") if c in nodes.columns]
    places = [f"_{i}" for i in range(width)]
    numbers = nodes.select(*on, *[F.get("vec", F.lit(i)).alias(p) for i, p in enumerate(places)])
    # looked up by hash, as the nodes are few beside the edges, which need no sort then
    along = views.join(numbers.hint("shuffle_hash"), on)
    w = F.col("w").cast("double")
    sums = along.groupBy("view", F.col("dst").alias("idx")).agg(F.sum(w).alias("_w"), *[F.sum(w * F.col(p)).alias(p) for p in places])
    return sums.select("view", "idx", F.array(*[F.col(p) / F.col("_w") for p in places]).alias("vec"))


def mean_shares(views: DataFrame) -> DataFrame:
    """``(view, src, dst, share)``: the part of each edge in the mean at its end."""
    total = views.groupBy("view", "dst").agg(F.sum("w").alias("total"))
    return views.join(total, ["view", "dst"]).select(
        "view", "src", "dst", (F.col("w") / F.col("total")).alias("share")
    )


def packed_shares(shares: DataFrame, width: int) -> EdgeParts | None:
    """:func:`packed_edges` of the shares, for :func:`sage_layer`."""
    return packed_edges(shares.withColumnRenamed("share", "w"), width)


def sage_layer(
    shares: DataFrame | EdgeParts, nodes: DataFrame, layers: Mapping[str, SageLayer], relu_first: bool = False
) -> DataFrame:
    """One convolution for all views: own(h) + mean of near(h) over neighbours.

    Both parts come from one pass over the nodes. Many shares are packed
    (:func:`packed_shares`), and only the sums meet the own part. Of few, the own part
    joins as one more edge of weight 1 from the node to itself, so one join with the
    wide vectors serves both.
    """

    def after_relu(lin: Linear):
        return (lambda x: lin(np.maximum(x, 0.0))) if relu_first else lin

    both = _project(nodes, {v: (after_relu(layer.near), after_relu(layer.own)) for v, layer in layers.items()})
    width = max(len(layer.own.bias) for layer in layers.values())
    packed = shares if isinstance(shares, EdgeParts) else packed_shares(shares, width)
    if packed:
        both = materialise(both, "projected")  # read for the sums and for the own part
        near = packed.sums(both.select("view", "idx", F.col("v0").alias("vec")), width)
        return _with_own(near, both.select("view", "idx", F.col("v1").cast("array<double>").alias("vec")), width)
    each = nodes.select("view", "idx") if "view" in nodes.columns else nodes.select(F.explode(F.array(*[F.lit(v) for v in layers])).alias("view"), "idx")
    selves = each.select("view", F.col("idx").alias("src"), F.col("idx").alias("dst"), F.lit(1.0).alias("share"), F.lit(True).alias("self"))
    edges = shares.select("view", "src", "dst", "share", F.lit(False).alias("self")).unionByName(selves)
    rows = edges.join(both.withColumnRenamed("idx", "src"), ["view", "src"]).select(
        "view", F.col("dst").alias("idx"), "share", F.when(F.col("self"), F.col("v1")).otherwise(F.col("v0")).alias("vec")
    )
    return weighted_sum(rows, ["view", "idx"], "share", width)


def _with_own(near: DataFrame, own: DataFrame, width: int) -> DataFrame:
    """``(view, idx, vec)``: the sum over a node's edges and its own part. Copies of a
    node meet each other, as the edge from a node to itself has them at both ends."""
    named = own.where("view IS NOT NULL AND idx IS NOT NULL").withColumn("own", F.lit(1))
    rows = blocked(near.withColumn("own", F.lit(0)).unionByName(named), width)
    places = range(min(width, BLOCK))

    def total(own: int, i: int) -> Column:
        return F.sum(F.when(F.col("own") == own, F.get("vec", F.lit(i))))

    cells = [total(own, i).alias(f"_{own}_{i}") for own in (0, 1) for i in places]
    sums = rows.groupBy("view", "idx", "block").agg(F.sum("own").alias("_copies"), *cells)
    # a node without edges, or an end that is no node, has one part only
    added = [F.coalesce(F.col(f"_0_{i}") + F.col("_copies") * F.col(f"_1_{i}"), F.col("_copies") * F.col(f"_1_{i}"), F.col(f"_0_{i}")) for i in places]
    return assembled(sums.select("view", "idx", "block", F.array(*added).alias("vec")), ["view", "idx"], width)


def _with_logit(layer: SageLayer, attention: Linear) -> SageLayer:
    """The layer with one more output, the attention logit of its result."""

    def extend(lin: Linear, bias: np.ndarray) -> Linear:
        more = attention.weight @ lin.weight
        return Linear(np.vstack([lin.weight, more]), np.concatenate([lin.bias, bias]))

    own_bias = attention.weight @ layer.own.bias + attention.bias
    return SageLayer(extend(layer.own, own_bias), extend(layer.near, np.zeros(1)))


def view_embeddings(shares: DataFrame, features: DataFrame, weights: ScorerWeights) -> DataFrame:
    """``(view, idx, vec, logit)`` after two layers with a ReLU in between;
    ``features`` is ``(idx, vec)``."""
    shares = materialise(shares, "shares")  # read by both layers
    packed = packed_shares(shares, weights.width + 1)
    if packed:
        discard(shares)
        shares = packed
    first = sage_layer(shares, features, {v: pair[0] for v, pair in weights.layers.items()})
    # read twice by the second layer
    first = materialise(first, "sage-hidden")
    second = {v: _with_logit(pair[1], weights.attention[v]) for v, pair in weights.layers.items()}
    h = sage_layer(shares, first, second, relu_first=True)
    return h.select(
        "view",
        "idx",
        F.slice("vec", 1, weights.width).alias("vec"),
        F.element_at("vec", weights.width + 1).alias("logit"),
    )


def attention_scaled(embeddings: DataFrame) -> DataFrame:
    """Add ``share``, exp(logit) relative to the node's largest: softmax up to
    its denominator, safe from overflow. A window, as a join with the largest
    would make the embeddings once for each of its sides."""
    top = F.max("logit").over(Window.partitionBy("idx"))
    return embeddings.where("idx IS NOT NULL").withColumn("share", F.exp(F.col("logit") - top))


def view_attention(embeddings: DataFrame) -> DataFrame:
    """``(view, idx, weight)``: softmax of the logits over the views of a node."""
    scaled = attention_scaled(embeddings.select("view", "idx", "logit"))
    total = F.sum("share").over(Window.partitionBy("idx"))
    return scaled.select("view", "idx", (F.col("share") / total).alias("weight"))


def node_embeddings(embeddings: DataFrame, width: int) -> DataFrame:
    """``(idx, vec)``: attention-weighted sum over the views of a node. The
    softmax denominator cancels in a weighted mean."""
    return weighted_sum(attention_scaled(embeddings), ["idx"], "share", width, mean=True)


def edge_scores(edges: DataFrame, nodes: DataFrame, weights: ScorerWeights) -> DataFrame:
    """``edges`` with ``score``; copies are kept.

    The hidden layer acts on [source, target], so each half is applied once per
    node, before the join, and not once per edge.
    """
    h = weights.width
    as_src = Linear(weights.hidden.weight[:, :h], np.zeros(h))
    as_dst = Linear(weights.hidden.weight[:, h:], weights.hidden.bias)
    out = weights.output

    # one pass over the nodes; each join reads the half it needs
    halves = materialise(_project(nodes, {"": (as_src, as_dst)}), "halves")
    at_src = halves.select(F.col("idx").alias("src"), F.col("v0").alias("_a"))
    at_dst = halves.select(F.col("idx").alias("dst"), F.col("v1").alias("_b"))

    @F.arrow_udf("double")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        if len(a) == 0:
            return pa.array([], pa.float64())
        logit = out(np.maximum(_matrix(a) + _matrix(b), 0.0))[:, 0]
        return pa.array(1.0 / (1.0 + np.exp(-logit)))

    return (
        edges.join(at_src, "src")
        .join(at_dst, "dst")
        .withColumn("score", score("_a", "_b"))
        .drop("_a", "_b")
    )


def score_candidates(edges: DataFrame, views: DataFrame, features: DataFrame, weights: ScorerWeights) -> DataFrame:
    """The whole forward function: candidate edges to scores."""
    h = view_embeddings(mean_shares(views), features, weights)
    return edge_scores(edges, node_embeddings(h, weights.width), weights)


def cosine_scores(edges: DataFrame, features: DataFrame) -> DataFrame:
    """``edges`` with ``score``: (1 + cosine of the endpoint vectors) / 2 to 6
    places; ``features`` is ``(idx, vec)``. A zero vector has no direction, its
    edges score null. Products are taken on Arrow batches, not per element."""

    @F.arrow_udf("double")
    def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
        if len(a) == 0:
            return pa.array([], pa.float64())
        x, y = _matrix(a).astype(np.float64), _matrix(b).astype(np.float64)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
        product = np.einsum("ij,ij->i", x, y)
        return pa.array(np.divide(product, norm, out=np.zeros_like(norm), where=norm > 0), mask=norm == 0)

    at_src = features.select(F.col("idx").alias("src"), F.col("vec").alias("_a"))
    at_dst = features.select(F.col("idx").alias("dst"), F.col("vec").alias("_b"))
    both = edges.join(at_src, "src").join(at_dst, "dst")
    return both.withColumn("score", F.round((1 + cosine("_a", "_b")) / 2, 6)).drop("_a", "_b")
