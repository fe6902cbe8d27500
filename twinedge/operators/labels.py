"""Truth labels of candidate links, class balancing, splits and negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinedge.operators.ordering import dense_index, running_total
from twinedge.schema import TRAIN_RATIO, VALID_RATIO
from twinedge.scratch import materialise


def label_candidates(candidates: DataFrame, truth: DataFrame, out: str = "label") -> DataFrame:
    """1 where the ordered pair (src, dst) is a truth edge, else 0.

    Copies of a candidate are kept, copies of a truth edge do not multiply it.
    """
    known = truth.select("src", "dst").distinct().withColumn("_known", F.lit(1))
    return candidates.join(known, ["src", "dst"], "left").withColumn(
        out, F.coalesce("_known", F.lit(0))
    ).drop("_known")


def orcid_labels(author_orcids: DataFrame) -> DataFrame:
    """``(idx, label)``: a dense number per distinct ORCID, in ORCID order.

    An empty and a null ORCID are one label each, as any other value.
    """
    numbered = dense_index(author_orcids, "orcid").withColumnRenamed("orcid", "_orcid")
    return author_orcids.join(numbered, F.col("orcid").eqNullSafe(F.col("_orcid"))).select(
        "idx", "label"
    )


def require_label_per_node(labels: DataFrame, num_nodes: int) -> DataFrame:
    """Raise when the number of labels differs from the number of nodes."""
    found = labels.count()
    if found != num_nodes:
        raise ValueError(f"{num_nodes} author labels expected, {found} found")
    return labels


def draw_key() -> Column:
    """Reproducible stand-in for the arbitrary edge order: a hash of the pair."""
    return F.md5(F.concat_ws("|", "src", "dst"))


def _ranked_by_class(labelled: DataFrame) -> tuple[DataFrame, int]:
    """Rank edges within their class; returns ``(ranked, rows of the smaller class)``.

    Copies of a pair become one row with ``copies``; ``first`` is the rank of
    the first copy.
    """
    grouped = (
        labelled.groupBy("label", "src", "dst")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("draw", draw_key())
    )
    ranked = running_total(grouped, ["label", "draw", "src", "dst"], "copies", "first", without=["draw"])
    sizes = {r["label"]: r["n"] for r in ranked.groupBy("label").agg(F.sum("copies").alias("n")).collect()}
    negatives, positives = sizes.get(0, 0), sizes.get(1, 0)
    ranked = ranked.withColumn("first", F.col("first") - F.when(F.col("label") == 1, negatives).otherwise(0))
    return ranked, min(negatives, positives)


def _overlap(lo: int, hi: int) -> Column:
    """Copies of a row whose ranks fall into [lo, hi)."""
    upto = F.least(F.col("first") + F.col("copies"), F.lit(hi))
    return F.greatest(upto - F.greatest(F.col("first"), F.lit(lo)), F.lit(0)).cast("long")


def balanced_edges(labelled: DataFrame) -> DataFrame:
    """The first m edges of each class, m being the size of the smaller class."""
    ranked, m = _ranked_by_class(labelled)
    return ranked.select("label", "src", "dst", _overlap(0, m).alias("copies")).where("copies > 0")


def edge_splits(
    labelled: DataFrame, train_ratio: float = TRAIN_RATIO, valid_ratio: float = VALID_RATIO
) -> DataFrame:
    """``(split, label, src, dst, copies)``, balanced; ``test`` takes the remainder.

    Copies of one pair may fall on both sides of a cut; the pair then appears
    in both splits with its share of the copies.
    """
    ranked, m = _ranked_by_class(labelled)
    cut1, cut2 = int(train_ratio * m), int((train_ratio + valid_ratio) * m)
    bounds = {"train": (0, cut1), "valid": (cut1, cut2), "test": (cut2, m)}
    shares = F.array(
        *[
            F.struct(F.lit(name).alias("split"), _overlap(lo, hi).alias("copies"))
            for name, (lo, hi) in bounds.items()
        ]
    )
    return (
        ranked.select("label", "src", "dst", F.explode(shares).alias("part"))
        .select("part.split", "label", "src", "dst", "part.copies")
        .where("copies > 0")
    )


def grouped_splits(
    labelled: DataFrame, train_ratio: float = TRAIN_RATIO, valid_ratio: float = VALID_RATIO
) -> DataFrame:
    """``(split, label, src, dst, copies)`` as :func:`edge_splits`, but with all
    edges between two nodes (both directions, all copies, both labels) in one split.

    Groups that hold a right edge come first: in the order of a hash they fill
    the splits' shares of right edges, a group going where its first right edge
    falls. The wrong edges they bring count, and groups of wrong edges alone
    fill up what is missing. At each cut a class exceeds its share by less than
    one group (and by what mixed groups bring, if that is more).
    """
    pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    groups = materialise(
        labelled.groupBy(*pair)
        .agg(F.count_if(F.col("label") == 1).alias("right"), F.count_if(F.col("label") == 0).alias("wrong"))
        .withColumn("draw", F.md5(F.concat_ws("|", "a", "b"))),
        "pair-groups",
    )
    sums = groups.agg(F.sum("right").alias("right"), F.sum("wrong").alias("wrong")).first()
    m = min(sums["right"] or 0, sums["wrong"] or 0)
    cuts = [0, int(train_ratio * m), int((train_ratio + valid_ratio) * m), m]
    names = ("train", "valid", "test")

    def placed(rows: DataFrame, amount: str, bounds: list[int]) -> DataFrame:
        split = F.lit(None).cast("string")
        for name, lo, hi in reversed(list(zip(names, bounds, bounds[1:]))):
            split = F.when((F.col("first") >= lo) & (F.col("first") < hi), F.lit(name)).otherwise(split)
        ranked = running_total(rows, ["draw", "a", "b"], amount, "first")
        return ranked.withColumn("split", split).where("split IS NOT NULL").select("a", "b", "wrong", "split")

    mixed = materialise(placed(groups.where("right > 0"), "right", cuts), "groups-with-right")
    brought = {r["split"]: r["n"] for r in mixed.groupBy("split").agg(F.sum("wrong").alias("n")).collect()}  # three rows
    upto = [0]
    for name, lo, hi in zip(names, cuts, cuts[1:]):
        upto.append(upto[-1] + max(0, hi - lo - brought.get(name, 0)))
    rest = placed(groups.where("right = 0"), "wrong", upto)
    assigned = mixed.unionByName(rest).select("a", "b", "split")
    edges = labelled.groupBy("label", "src", "dst").agg(F.count(F.lit(1)).alias("copies"))
    return edges.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}).join(assigned, ["a", "b"]).select(
        "split", "label", "src", "dst", "copies"
    )


def split_leakage(splits: DataFrame) -> DataFrame:
    """``(a, b, first_split, last_split, copies)``: unordered pairs whose edges
    are in more than one split, in either direction."""
    pair = splits.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pair.agg(
        F.min("split").alias("first_split"), F.max("split").alias("last_split"), F.sum("copies").alias("copies")
    ).where("first_split <> last_split")


def split_sizes(splits: DataFrame) -> DataFrame:
    return splits.groupBy("split", "label").agg(F.sum("copies").alias("edges"))


def expand_copies(df: DataFrame, chunk: int = 10_000) -> DataFrame:
    """One row per copy. Rows with many copies are cut into chunks which are
    spread over all tasks before they are expanded. A chunk grows with the
    root of the copies, so neither step makes a long array of one row."""
    sized = df.withColumn("_size", F.greatest(F.lit(chunk), F.ceil(F.sqrt("copies"))))
    chunks = sized.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(copies - 1) div _size")))
    )
    spread = chunks.repartition(*chunks.columns)
    left = F.least(F.col("_size"), F.col("copies") - F.col("_chunk") * F.col("_size"))
    return spread.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), left))).drop(
        "_copy", "_chunk", "_size", "copies"
    )


def negative_edges(edges: DataFrame, k: int, num_nodes: int, seed: int = 0) -> DataFrame:
    """Each edge ``k`` times with its source kept and a hashed destination.

    The destination comes from a hash of the edge, so a retried task draws the
    same one. 60 hash bits keep it uniform over any number of nodes. True edges
    and self pairs may be drawn, as with a uniform random choice.
    """
    drawn = F.conv(
        F.substring(F.md5(F.concat_ws("|", "src", "dst", "draw", F.lit(seed))), 1, 15), 16, 10
    ).cast("long")
    return (
        edges.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .withColumn("neg_dst", drawn % F.lit(num_nodes).cast("long"))
    )
