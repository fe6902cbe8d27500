"""Graph construction: id resolution, edge types, metapaths, author views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinedge.schema import AUTHOR, EDGE_TYPES, PUBLICATION, VIEWS
from twinedge.scratch import at_once, materialise

# A join key whose matches exceed this many output rows is cut into cells.
HUB_OUTPUT = 50_000_000
HUB_SIDE = 5_000
HUB_BUCKETS = 1 << 16


# ---- id resolution -------------------------------------------------------

def resolve_edges(raw: DataFrame, src_nodes: DataFrame, dst_nodes: DataFrame) -> DataFrame:
    """``(src, dst)`` indices of ``raw(src_id, dst_id)``; nodes are ``(id, idx)``.

    Inner joins on a bag: copies stay, edges with an unknown end are dropped.
    """
    at_src = src_nodes.select(F.col("id").alias("src_id"), F.col("idx").alias("src"))
    at_dst = dst_nodes.select(F.col("id").alias("dst_id"), F.col("idx").alias("dst"))
    return raw.join(at_src, "src_id").join(at_dst, "dst_id").select("src", "dst")


def resolve_relations(
    raw: Mapping[str, DataFrame], authors: DataFrame, publications: DataFrame
) -> DataFrame:
    """``(etype, src, dst)`` for all relations at once.

    Edges with an unknown end are left out; :func:`marked_relations` keeps them.
    """
    marked = marked_relations(raw, authors, publications)
    return marked.where("src IS NOT NULL AND dst IS NOT NULL").select("etype", "src", "dst")


def marked_relations(
    raw: Mapping[str, DataFrame], authors: DataFrame, publications: DataFrame
) -> DataFrame:
    """``(etype, src, dst, src_id, dst_id, line)`` for all relations at once: an
    index is null where its id is unknown, and only then the ids are kept.

    ``raw[etype]`` has ``src_id, dst_id`` and, if it was not sifted yet, ``line``
    with the text of malformed lines. The relations are stacked and the two
    node sets are one lookup keyed by (type, id), so 2 joins serve all of them
    instead of 2 per relation. Types go by their numbers, as the names would be most
    of a row.
    """
    names, types = list(raw), [AUTHOR, PUBLICATION]

    def number(of: Sequence[str], name: str):
        return F.lit(of.index(name)).cast("byte")

    nodes = authors.select(number(types, AUTHOR).alias("ntype"), "id", "idx").unionByName(
        publications.select(number(types, PUBLICATION).alias("ntype"), "id", "idx")
    )
    stacked = reduce(
        DataFrame.unionByName,
        [
            edges.select(
                number(names, etype).alias("number"),
                number(types, EDGE_TYPES[etype].src_type).alias("src_type"),
                "src_id",
                number(types, EDGE_TYPES[etype].dst_type).alias("dst_type"),
                "dst_id",
                (F.col("line") if "line" in edges.columns else F.lit(None).cast("string")).alias("line"),
            )
            for etype, edges in raw.items()
        ],
    )
    at_src = nodes.toDF("src_type", "src_id", "src")
    at_dst = nodes.toDF("dst_type", "dst_id", "dst")
    unknown = F.col("src").isNull() | F.col("dst").isNull()
    etype = F.element_at(F.array(*[F.lit(t) for t in names]), F.col("number") + 1).alias("etype")
    return (
        stacked.join(at_src, ["src_type", "src_id"], "left")
        .join(at_dst, ["dst_type", "dst_id"], "left")
        .select(etype, "src", "dst", *[F.when(unknown, F.col(c)).alias(c) for c in ("src_id", "dst_id")], "line")
    )


def dropped_edges(marked: DataFrame) -> DataFrame:
    """``(etype, malformed, unknown_src, unknown_dst)`` of marked relations."""
    read = F.col("line").isNull()
    return marked.groupBy("etype").agg(
        F.count_if(~read).alias("malformed"),
        F.count_if(read & F.col("src").isNull()).alias("unknown_src"),
        F.count_if(read & F.col("dst").isNull()).alias("unknown_dst"),
    )


def unresolved_report(raw: DataFrame, src_nodes: DataFrame, dst_nodes: DataFrame) -> DataFrame:
    """How many raw edges have both ends, no source, or no destination."""
    at_src = src_nodes.select(F.col("id").alias("src_id")).distinct().withColumn("s", F.lit(1))
    at_dst = dst_nodes.select(F.col("id").alias("dst_id")).distinct().withColumn("d", F.lit(1))
    return (
        raw.join(at_src, "src_id", "left")
        .join(at_dst, "dst_id", "left")
        .agg(
            F.count(F.lit(1)).alias("raw_edges"),
            F.count_if(F.col("s").isNotNull() & F.col("d").isNotNull()).alias("resolved"),
            F.count_if(F.col("s").isNull()).alias("unknown_src"),
            F.count_if(F.col("d").isNull()).alias("unknown_dst"),
        )
    )


# ---- the heterogeneous graph as one edge table ---------------------------

def reverse_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def edge_table(edges: Mapping[str, DataFrame]) -> DataFrame:
    """``(etype, src, dst)``; ``is_written_by`` is the reverse of ``writes``."""
    typed = dict(edges)
    if "writes" in typed:
        typed.setdefault("is_written_by", reverse_edges(typed["writes"]))
    return reduce(
        DataFrame.unionByName,
        [e.select(F.lit(t).alias("etype"), "src", "dst") for t, e in typed.items()],
    )


def subgraph(graph: DataFrame, etype: str) -> DataFrame:
    """Edges of one type; on the stored table this prunes to one partition."""
    return graph.where(F.col("etype") == etype).select("src", "dst")


def degrees(graph: DataFrame) -> DataFrame:
    """``(etype, side, idx, degree)`` for nodes with at least one edge."""
    ends = F.array(
        F.struct(F.lit("src").alias("side"), F.col("src").alias("idx")),
        F.struct(F.lit("dst").alias("side"), F.col("dst").alias("idx")),
    )
    return (
        graph.select("etype", F.explode(ends).alias("end"))
        .groupBy("etype", "end.side", "end.idx")
        .agg(F.count(F.lit(1)).alias("degree"))
    )


def degree_stats(graph: DataFrame) -> DataFrame:
    return (
        degrees(graph)
        .groupBy("etype", "side")
        .agg(
            F.count(F.lit(1)).alias("nodes"),
            F.sum("degree").alias("edges"),
            F.max("degree").alias("max_degree"),
        )
    )


def graph_summary(graph: DataFrame) -> DataFrame:
    """Per edge type: edges, distinct sources, distinct destinations.

    Counted from the degrees, which combine map-side; a distinct count per
    type would send each end twice to the few tasks that own a type.
    """
    at = F.col("side") == "src"
    return (
        degree_stats(graph)
        .groupBy("etype")
        .agg(
            F.max(F.when(at, F.col("edges"))).alias("edges"),
            F.max(F.when(at, F.col("nodes"))).alias("sources"),
            F.max(F.when(~at, F.col("nodes"))).alias("destinations"),
        )
    )


# ---- integrity -----------------------------------------------------------

def integrity_report(nodes: Mapping[str, DataFrame], graph: DataFrame) -> DataFrame:
    """``(check, subject, violations)``; all zero for a sound graph.

    ``nodes[type]`` is ``(idx, feat)``. Indices must be unique and exactly
    0..n-1, features of one width, edge ends existing indices. Given the first,
    a range test replaces the join for the last.
    """
    counts = {
        t: tuple(df.agg(F.count(F.lit(1)), F.min("idx"), F.max("idx")).first()) for t, df in nodes.items()
    }
    spark = graph.sparkSession
    gaps = [
        ("contiguous", t, 0 if (n, lo, hi) == (n, 0, n - 1) else 1) for t, (n, lo, hi) in counts.items()
    ]
    reports = [spark.createDataFrame(gaps, "check string, subject string, violations bigint")]
    for ntype, df in nodes.items():
        twice = df.groupBy("idx").agg(F.count(F.lit(1)).alias("n"))
        reports.append(
            twice.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(
                F.lit("unique").alias("check"), F.lit(ntype).alias("subject"), "violations"
            )
        )
        widths = df.groupBy(F.size("feat").alias("width")).agg(F.count(F.lit(1)).alias("n"))
        reports.append(
            widths.agg((F.coalesce(F.sum("n") - F.max("n"), F.lit(0))).alias("violations")).select(
                F.lit("feature_width").alias("check"), F.lit(ntype).alias("subject"), "violations"
            )
        )

    def size_of(side: str):
        cases = F.lit(None).cast("long")
        for etype, kind in EDGE_TYPES.items():
            n = counts[getattr(kind, f"{side}_type")][0]
            cases = F.when(F.col("etype") == etype, F.lit(n).cast("long")).otherwise(cases)
        return cases

    inside = F.col("src").between(0, size_of("src") - 1) & F.col("dst").between(0, size_of("dst") - 1)
    reports.append(
        graph.groupBy("etype")
        .agg(F.count_if(~inside).alias("violations"))
        .select(F.lit("edge_range").alias("check"), F.col("etype").alias("subject"), "violations")
    )
    return reduce(DataFrame.unionByName, reports)


def require_intact(report: DataFrame) -> None:
    broken = report.where("violations > 0").collect()  # a row per check and edge type
    if broken:
        raise ValueError(f"graph is not sound: {[tuple(r) for r in broken]}")


# ---- metapaths and views -------------------------------------------------

def _hubs(frontier: DataFrame, edges: DataFrame, hub_output: int, side: int) -> DataFrame | None:
    """Join keys with too many matches, and into how many parts to cut each side;
    None where a sum shows that there are none.

    A key has at most the matches that its bucket would have as one key. Only
    keys of buckets above the bound are counted one by one, so where no bucket is,
    nothing but sums of buckets is shuffled.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = frontier.select(F.col("at").alias("key"), one.alias("l"), none.alias("r")).unionByName(
        edges.select(F.col("src").alias("key"), none.alias("l"), one.alias("r"))
    )
    ends = ends.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(HUB_BUCKETS)))
    # as doubles: the product of two long counts may not fit a long
    above = F.col("l").cast("double") * F.col("r") > hub_output
    full = materialise(
        ends.groupBy("bucket").agg(F.sum("l").alias("l"), F.sum("r").alias("r")).where(above).select("bucket"), "hub-buckets"
    )
    if full.isEmpty():
        return None
    return (
        ends.join(full, "bucket", "left_semi")
        .groupBy("key")
        .agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
        .where(above)
        .select(
            "key",
            F.ceil(F.col("l") / side).cast("int").alias("l_parts"),
            F.ceil(F.col("r") / side).cast("int").alias("r_parts"),
        )
    )


def _hop(frontier: DataFrame, edges: DataFrame, hub_output: int, side: int) -> DataFrame:
    """(start, at) one edge further, with copies.

    A hub has in x out matches, which no split by input size sees. Its rows are
    therefore laid on a grid: the left side is cut by start, the right side by
    end, and each cell (key, i, j) is a join of at most about side x side rows.
    """
    hubs = _hubs(frontier, edges, hub_output, side)
    if hubs is None:
        return frontier.join(edges, F.col("at") == F.col("src")).select("start", F.col("dst").alias("at"))
    hubs = materialise(hubs, "hubs")
    parts = {p: F.coalesce(p, F.lit(1)) for p in ("l_parts", "r_parts")}

    def cells(part):
        return F.explode(F.sequence(F.lit(0), part - 1))

    left = (
        frontier.withColumnRenamed("at", "key")
        .join(hubs, "key", "left")
        .select(
            "key",
            "start",
            F.pmod(F.xxhash64("start"), parts["l_parts"]).cast("int").alias("i"),
            cells(parts["r_parts"]).alias("j"),
        )
    )
    right = (
        edges.select(F.col("src").alias("key"), "dst")
        .join(hubs, "key", "left")
        .select(
            "key",
            "dst",
            F.pmod(F.xxhash64("dst"), parts["r_parts"]).cast("int").alias("j"),
            cells(parts["l_parts"]).alias("i"),
        )
    )
    return left.join(right, ["key", "i", "j"]).select("start", F.col("dst").alias("at"))


def _frontier(edges: DataFrame) -> DataFrame:
    """Distinct (start, at) after the first edge, written once: a hop reads it twice."""
    return materialise(edges.select(F.col("src").alias("start"), F.col("dst").alias("at")).distinct(), "frontier")


def metapath(
    edges: Mapping[str, DataFrame],
    path: Sequence[str],
    hub_output: int = HUB_OUTPUT,
    side: int = HUB_SIDE,
) -> DataFrame:
    """Distinct ``(src, dst)`` such that a walk along ``path`` leads from src to dst."""
    return _walks(edges, path, hub_output, side).distinct()


def _walks(
    edges: Mapping[str, DataFrame],
    path: Sequence[str],
    hub_output: int = HUB_OUTPUT,
    side: int = HUB_SIDE,
    begun: DataFrame | None = None,
) -> DataFrame:
    """:func:`metapath` before copies are removed after the last edge.

    The frontier is made distinct after each other hop (the optimizer does not
    push a distinct below a join) and written once, as the next hop reads it
    twice. ``begun`` is the frontier after the first edge, where paths share it.
    """
    first, *rest = path
    if not rest:
        return edges[first].select("src", "dst")
    frontier = _frontier(edges[first]) if begun is None else begun
    for n, etype in enumerate(rest):
        if n:
            frontier = materialise(frontier.distinct(), "frontier")
        frontier = _hop(frontier, edges[etype].select("src", "dst"), hub_output, side)
    return frontier.select(F.col("start").alias("src"), F.col("at").alias("dst"))


def with_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(src, dst, w)``: copies become weight, every node gets one loop more.

    An existing self pair is not replaced, so its weight grows by one.
    """
    loops = nodes.select(F.col("idx").alias("src"), F.col("idx").alias("dst"))
    return edges.select("src", "dst").unionByName(loops).groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("w")
    )


def author_views(edges: Mapping[str, DataFrame], author_nodes: DataFrame) -> DataFrame:
    """``(view, src, dst, w)``: the four author graphs, each with self-loops.

    A link of a metapath counts once, a copy of any other edge and a loop each.
    """
    begun = {t: _frontier(edges[t]) for t in sorted({p[0] for p in VIEWS.values() if len(p) > 1})}
    # a walk runs jobs of its own; the paths do not depend on each other
    walks = at_once({v: lambda p=p: _walks(edges, p, begun=begun.get(p[0])) for v, p in VIEWS.items()})
    # a view goes by its number, as a name would be longer than the rest of a row
    names = list(VIEWS)
    loops = author_nodes.select(
        F.explode(F.array(*[F.lit(k) for k in range(len(names))])).alias("number"),
        F.col("idx").alias("src"),
        F.col("idx").alias("dst"),
        F.lit(0).alias("linked"),
        F.lit(1).alias("copies"),
    )
    stacked = [
        walks[v].select(F.lit(k).alias("number"), "src", "dst", F.lit(int(len(p) > 1)).alias("linked"), F.lit(int(len(p) == 1)).alias("copies"))
        for k, (v, p) in enumerate(VIEWS.items())
    ]
    # one aggregate removes the copies of walks and counts the others
    counted = (
        reduce(DataFrame.unionByName, [*stacked, loops])
        .groupBy("src", "dst", "number")
        .agg((F.max("linked") + F.sum("copies")).alias("w"))
    )
    name = F.element_at(F.array(*[F.lit(v) for v in names]), F.col("number") + 1)
    return counted.select(name.alias("view"), "src", "dst", "w")
