"""The stored graph of a raw dataset, and the evaluations run on it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinedge.operators import embed, graph, labels
from twinedge.plans import train
from twinedge.plans.inspect import inspection_report
from twinedge.plans.sweep import threshold_sweep
from twinedge.schema import AUTHOR, EDGE_TYPES, HIDDEN_WIDTH, NODE_DATASETS, PUBLICATION
from twinedge.scratch import materialise
from twinedge.sources import raw
from twinedge.sources.runs import RunStore
from twinedge.sources.store import SET_ASIDE, GraphStore, nodes_path

Scorer = Callable[["EntityGraph", DataFrame], DataFrame]


def build_graph(
    spark: SparkSession, raw_dir: str, tolerance: int = 0, draft: str | None = None
) -> tuple[dict[str, DataFrame], DataFrame, dict[str, DataFrame]]:
    """``(nodes, edges, reports)`` of the ten raw datasets, checked for soundness.

    The reports are ``quarantine`` (dataset, line, reason), ``unresolved`` (dataset,
    src_id, dst_id) and ``drops`` (dataset, malformed, unknown_src, unknown_dst).
    More than ``tolerance`` malformed lines and unresolved edges are an error. The
    node tables, the largest, are written once: to the ``draft`` of a store, if given.
    """
    missing = raw.missing_datasets(spark, raw_dir)
    if missing:
        raise FileNotFoundError(f"no data for {missing} in {raw_dir}")

    def written(t: str, name: str) -> DataFrame:
        rows = raw.sifted(raw.parse_nodes(spark.read.text(f"{raw_dir}/{name}"), t)).withColumnRenamed("line", SET_ASIDE)
        return materialise(rows, name, nodes_path(draft, t) if draft else None).withColumnRenamed(SET_ASIDE, "line")

    # text is parsed once, not once for each relation and check
    parsed = {t: written(t, name) for t, name in NODE_DATASETS.items()}
    nodes = {t: raw.well_formed(rows) for t, rows in parsed.items()}
    relations = {
        t: raw.sifted(raw.parse_edges(spark.read.text(f"{raw_dir}/{kind.dataset}")))
        for t, kind in EDGE_TYPES.items() if kind.dataset
    }
    marked = materialise(graph.marked_relations(relations, nodes[AUTHOR], nodes[PUBLICATION]), "relations")
    dataset = F.col("etype")
    for etype, kind in EDGE_TYPES.items():
        dataset = F.when(F.col("etype") == etype, F.lit(kind.dataset)).otherwise(dataset)
    by_node = [
        rows.agg(F.lit(NODE_DATASETS[t]).alias("dataset"), F.count("line").alias("malformed"))
        .withColumn("unknown_src", F.lit(0).cast("long")).withColumn("unknown_dst", F.lit(0).cast("long"))
        for t, rows in parsed.items()
    ]
    by_edge = graph.dropped_edges(marked).withColumn("dataset", dataset).drop("etype")
    drops = materialise(reduce(DataFrame.unionByName, [*by_node, by_edge]), "drops")
    # a row per dataset
    lost = {r["dataset"]: tuple(r)[1:] for r in drops.select("dataset", "malformed", "unknown_src", "unknown_dst").collect() if any(tuple(r)[1:])}
    if sum(map(sum, lost.values())) > tolerance:
        raise ValueError(f"more than {tolerance} lines or edges are unusable; (malformed, unknown source, unknown destination) by dataset: {lost}")
    # the few lines set aside are read once more, for the reason
    quarantine = [
        raw.node_faults(raw.quarantine(rows).withColumnRenamed("line", "value")).select(F.lit(NODE_DATASETS[t]).alias("dataset"), "line", "reason")
        for t, rows in parsed.items()
    ]
    quarantine.append(marked.where("line IS NOT NULL").select(dataset.alias("dataset"), "line", F.lit("no tuple").alias("reason")))
    reports = {
        "quarantine": reduce(DataFrame.unionByName, quarantine),
        "unresolved": marked.where("line IS NULL AND (src IS NULL OR dst IS NULL)").select(dataset.alias("dataset"), "src_id", "dst_id"),
        "drops": drops,
    }
    resolved = marked.where("src IS NOT NULL AND dst IS NOT NULL").select("etype", "src", "dst")
    written_by = graph.reverse_edges(graph.subgraph(resolved, "writes"))
    edges = resolved.unionByName(written_by.select(F.lit("is_written_by").alias("etype"), "src", "dst"))
    graph.require_intact(graph.integrity_report(nodes, edges))
    return nodes, edges, reports


class EntityGraph:
    """Node and edge tables of a store, with the author side of the analyses."""

    def __init__(self, store: GraphStore):
        self.store = store
        self.spark = store.spark

    @classmethod
    def open(
        cls, spark: SparkSession, raw_dir: str, save_dir: str, force_reload: bool = False, tolerance: int = 0
    ) -> EntityGraph:
        """Use the stored graph, or build it from the raw datasets first."""
        stored = GraphStore(spark, save_dir)
        return cls(stored.load_or_build(lambda draft: build_graph(spark, raw_dir, tolerance, draft), force_reload, drafted=True))

    def drops(self) -> DataFrame:
        """``(dataset, malformed, unknown_src, unknown_dst)`` of the build."""
        return self.store.report("drops")

    def edges(self, etype: str | None = None) -> DataFrame:
        table = self.store.edges().select("etype", "src", "dst")
        return graph.subgraph(table, etype) if etype else table

    @cached_property
    def authors(self) -> DataFrame:
        return self.store.nodes(AUTHOR)

    @property
    def identities(self) -> DataFrame:
        return self.authors.select("idx", "orcid")

    @property
    def features(self) -> DataFrame:
        return self.store.bucketed("features", "idx", lambda: self.authors.select("idx", F.col("feat").alias("vec")))

    @cached_property
    def views(self) -> DataFrame:
        """The author views, kept with the stored graph by the source of an edge,
        as the vectors at the sources are."""
        by_type = {t: self.edges(t) for t in EDGE_TYPES}
        return self.store.bucketed("views", "src", lambda: graph.author_views(by_type, self.authors))

    def splits(self, train_ratio: float = 0.6, valid_ratio: float = 0.2) -> DataFrame:
        labelled = labels.label_candidates(self.edges("similar"), self.edges("equates"))
        return labels.edge_splits(labelled, train_ratio, valid_ratio)

    def evaluate_thresholds(self, scorer: Scorer, **options) -> DataFrame:
        scored = scorer(self, self.edges("similar_for_dedup"))
        return threshold_sweep(scored, self.edges("equates"), self.identities, **options)

    def inspect(self, scorer: Scorer, **options) -> DataFrame:
        return inspection_report(scorer(self, self.edges("similar")), self.edges("equates"), self.authors, **options)

    def train(self, root: str, run_id: str, width: int = HIDDEN_WIDTH, **options) -> train.TrainedScorer:
        """Train on the balanced splits, in the folder of the run; a run that was
        cut off goes on with its own reducer."""
        run = RunStore(self.spark, root, run_id)
        if not run.committed_round():
            train.fit_reducer(self.features, width).write().overwrite().save(run.reducer)
        vectors = self.training_vectors(run)
        return train.train_edge_scorer(vectors, root, run_id, **options)

    def training_vectors(self, run: RunStore) -> DataFrame:
        nodes = train.node_vectors(self.views, self.features, PipelineModel.load(run.reducer))
        return train.training_vectors(self.splits(), nodes)

    def evaluate(self, trained: train.TrainedScorer, **options) -> DataFrame:
        """Loss, accuracy and confusion cells of a trained scorer on split ``test``."""
        return train.evaluate_edge_scorer(trained, self.training_vectors(trained.run(self.spark)), **options)


def weights_scorer(weights: embed.ScorerWeights) -> Scorer:
    """Score by the forward function with given weights."""
    return lambda g, edges: embed.score_candidates(edges, g.views, g.features, weights)


def trained_scorer(trained: train.TrainedScorer) -> Scorer:
    """Score by a trained classifier."""

    def score(g: EntityGraph, edges: DataFrame) -> DataFrame:
        reducer = PipelineModel.load(trained.run(g.spark).reducer)
        nodes = train.node_vectors(g.views, g.features, reducer)
        scored = train.with_scores(trained.model(), train.edge_vectors(edges, nodes))
        return scored.select(*edges.columns, "score")

    return score
