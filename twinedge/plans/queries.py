"""Every operator as a query over the test tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinedge.functions import text
from twinedge.functions.scalar import is_above
from twinedge.operators import blocking, embed, graph, labels, metrics, ordering, sketches
from twinedge.operators.components import connected_components
from twinedge.operators.incremental import ComponentStore
from twinedge.plans import inspect, sweep, train
from twinedge.plans.entities import EntityGraph
from twinedge.plans.fixture import DerivedGraph
from twinedge.schema import AUTHOR, EDGE_TYPES, NODE_DATASETS, PUBLICATION, RAW_DATASETS, VIEWS
from twinedge.scratch import at_once, materialise, new_path
from twinedge.session import configure
from twinedge.sources import raw, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, exact counts back to LONG."""
    shown = {T.DoubleType: lambda c: F.round(c, 6), T.DecimalType: lambda c: F.col(c).cast("long")}
    return df.select(
        *[
            shown[type(f.dataType)](f.name).alias(f.name) if type(f.dataType) in shown else f.name
            for f in df.schema.fields
        ]
    )


def query(name: str) -> Callable[[Callable[[DerivedGraph], DataFrame]], Callable[[DerivedGraph], DataFrame]]:
    def register(build: Callable[[DerivedGraph], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(build(DerivedGraph(configure(spark), sf_dir)))

        QUERIES[name] = run
        return build

    return register


# ---- inputs shared by several queries ------------------------------------

def sim_scored(g: DerivedGraph) -> DataFrame:
    return g.cosine_scores(g.similar)


def sim_labelled(g: DerivedGraph) -> DataFrame:
    return labels.label_candidates(sim_scored(g), g.equates)


def linked(g: DerivedGraph) -> DataFrame:
    """The deduplication edges that survive 0.6."""
    return metrics.prune_edges(g.cosine_scores(g.similar_for_dedup), 0.6)


def identities(g: DerivedGraph) -> DataFrame:
    return g.authors.select("idx", "orcid")


def _gapped(orcid: str = "orcid"):
    """The ORCID with some left out ('') and some null."""
    i = F.col("idx") % 50
    return F.when(i == 1, F.lit("")).when(i == 2, F.lit(None).cast("string")).otherwise(F.col(orcid))


def all_edges(g: DerivedGraph) -> dict[str, DataFrame]:
    return {t: g.edges(t) for t in EDGE_TYPES}


def path_edges(g: DerivedGraph, *names: str) -> dict[str, DataFrame]:
    """The edges on the paths of some views (all if none is named), with those
    that take a group and a join to derive written once."""
    types = sorted({t for v in names or VIEWS for t in VIEWS[v]})

    def made(t: str) -> DataFrame:
        return materialise(g.edges(t), f"edges-{t}") if t in ("cites", "coprojected") else g.edges(t)

    return at_once({t: lambda t=t: made(t) for t in types})


def node_ids(g: DerivedGraph, ntype: str) -> DataFrame:
    return (g.authors if ntype == AUTHOR else g.publications).select("id", "idx")


def candidates_with_copies(g: DerivedGraph) -> DataFrame:
    edges = g.similar
    twice = edges.unionByName(edges.where("src % 7 = 0"))
    return labels.label_candidates(twice, g.equates)


# ---- raw datasets --------------------------------------------------------

def author_lines(g: DerivedGraph) -> DataFrame:
    """Raw author lines, with ORCIDs left out or null, and some broken lines."""
    rows = g.authors.join(g.author_features, "idx").withColumn("orcid", _gapped())
    payload = F.struct("id", "fullname", "name", "surname", "orcid", F.col("feat").alias("pub_embedding"))
    # JSON without null fields, or with them written out
    line = F.when(F.col("idx") % 50 == 1, F.to_json(payload)).otherwise(
        F.to_json(payload, {"ignoreNullFields": "false"})
    )
    good = raw.node_lines(rows, line)
    broken = g.authors.where("idx % 40 = 0").select(F.concat(F.lit("('{\"id\": \""), "id", F.lit("\"', ")).alias("value"))
    return good.unionByName(broken)


def publication_lines(g: DerivedGraph) -> DataFrame:
    # many publications share a vector, whose text is made once
    feat = F.concat(F.lit(',"bert_embedding":'), F.to_json("feat"))
    rows = g.publications.join(g.with_vectors(feat.alias("feat")), "idx")
    payload = F.concat(F.lit('{"id":"'), "id", F.lit('"'), F.coalesce("feat", F.lit("")), F.lit("}"))
    return raw.node_lines(rows, payload)


def write_raw(g: DerivedGraph, *datasets: str) -> str:
    folder = new_path(g.spark, "raw")
    by_dataset = {e.dataset: t for t, e in EDGE_TYPES.items() if e.dataset}

    def lines(name: str) -> DataFrame:
        if name == NODE_DATASETS[AUTHOR]:
            return author_lines(g)
        if name == NODE_DATASETS[PUBLICATION]:
            return publication_lines(g)
        return raw.edge_lines(g.raw_edges(by_dataset[name]))

    planned = {name: lines(name) for name in datasets}
    at_once({name: lambda name=name: raw.write_lines(planned[name], folder, name) for name in datasets})
    return folder


@query("scan_nodes")
def _(g):
    nodes = raw.scan_nodes(g.spark, write_raw(g, "authors"), AUTHOR)
    return nodes.select(
        "idx", "id", "fullname", "name", "surname", "orcid",
        F.size("feat").alias("width"),
        F.round(F.element_at("feat", 1).cast("double"), 4).alias("first_feat"),
    )


@query("scan_publications")
def _(g):
    nodes = raw.scan_nodes(g.spark, write_raw(g, "publications"), PUBLICATION)
    last = F.round(F.element_at("feat", -1).cast("double"), 4)
    return nodes.select("idx", "id", F.size("feat").alias("width"), last.alias("last_feat"))


@query("quarantined_lines")
def _(g):
    lines = g.spark.read.text(f"{write_raw(g, 'authors')}/authors")
    return raw.quarantine(raw.parse_nodes(lines, AUTHOR))


def faulty_lines(g: DerivedGraph) -> DataFrame:
    """Author lines with one fault each, by index, next to good ones."""
    i = F.col("idx")
    payload = F.to_json(F.struct("id", "fullname"))
    line = raw.python_quoted(payload)
    cut = raw.python_quoted(F.substring(payload, 1, 12))
    shown = (
        F.when(i % 11 == 1, F.concat(F.lit("("), line, F.lit(", ")))
        .when(i % 11 == 2, F.concat(F.lit("("), cut, F.lit(", "), i.cast("string"), F.lit(")")))
        .when(i % 11 == 3, F.concat(F.lit("('[1, 2]', "), i.cast("string"), F.lit(")")))
        .when(i % 11 == 4, F.concat(F.lit("('{\"name\": \"x\", \"id\": null}', "), i.cast("string"), F.lit(")")))
        .when(i % 11 == 5, F.concat(F.lit("("), line, F.lit(", -"), (i + 1).cast("string"), F.lit(")")))
        .when(i % 11 == 6, F.concat(F.lit("("), line, F.lit(", 9"), F.lpad(i.cast("string"), 19, "9"), F.lit(")")))
        .when(i % 11 == 7, F.concat(F.lit("("), line, F.lit(", 1000000000"), F.lpad(i.cast("string"), 8, "0"), F.lit(")")))
        .otherwise(F.concat(F.lit("("), line, F.lit(", "), i.cast("string"), F.lit(")")))
    )
    return g.authors.select(shown.alias("value"))


@query("quarantine_reasons")
def _(g):
    """Lines that cannot be used, by reason."""
    folder = new_path(g.spark, "faulty")
    raw.write_lines(faulty_lines(g), folder, "authors")
    faults = raw.node_faults(g.spark.read.text(f"{folder}/authors"), g.num_authors)
    return faults.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


@query("scan_edges")
def _(g):
    return raw.scan_edges(g.spark, write_raw(g, "writes_rels"), "writes_rels")


@query("author_orcids")
def _(g):
    return raw.author_orcids(g.spark, write_raw(g, "authors"))


@query("dataset_completeness")
def _(g):
    present = [d for d in RAW_DATASETS if d != "simrels_dedup"]
    return raw.dataset_completeness(g.spark, write_raw(g, *present))


@query("sink_json_gz")
def _(g):
    path = new_path(g.spark, "json")
    raw.write_json_gz(g.authors.select("idx", "fullname", "name"), path)
    lines = g.spark.read.text(path)
    row = F.from_json("value", "idx bigint, fullname string, name string")
    return lines.select(row.alias("r"), F.col("value").contains('"name":').alias("name_written")).select(
        "r.idx", "r.fullname", "r.name", "name_written"
    )


@query("graph_store_roundtrip")
def _(g):
    edges = all_edges(g) | path_edges(g)  # built twice

    def build():
        nodes = {
            AUTHOR: g.authors.join(g.author_features, "idx").select("idx", "id", "orcid", "feat"),
            PUBLICATION: g.publications,
        }
        return nodes, graph.edge_table(edges)

    stored = store.GraphStore(g.spark, new_path(g.spark, "graph")).load_or_build(build)
    stored.load_or_build(build, force_reload=True)
    return graph.graph_summary(stored.edges().select("etype", "src", "dst"))


@query("model_store_roundtrip")
def _(g):
    root = new_path(g.spark, "models")
    rows = g.table("embeddings").select(
        (F.col("label") % 2).cast("double").alias("label"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
    )
    trainer = MultilayerPerceptronClassifier(layers=[64, 4, 2], maxIter=2, seed=1)
    for epoch in (1, 2):
        model = trainer.fit(rows)
        path = store.save_model(g.spark, model, root, epoch)
        trainer.setInitialWeights(model.weights)
    again = MultilayerPerceptronClassificationModel.load(path)
    before, after = (train.with_scores(m, rows.withColumn("label", F.col("label"))) for m in (model, again))
    tagged = [d.select(F.lit(k).alias("again"), F.hash("features").alias("h"), "score") for k, d in enumerate((before, after))]
    by_row = tagged[0].unionByName(tagged[1]).groupBy("h").agg(
        F.count_if(F.col("again") == 0).alias("n"), F.min("score").alias("a"), F.max("score").alias("b")
    )
    singles = tagged[0].groupBy("h").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    differing = by_row.join(singles, "h").select("n", ((F.col("a") != F.col("lo")) | (F.col("b") != F.col("hi"))).alias("differs"))
    return differing.agg(
        F.sum("n").alias("rows"), F.count_if("differs").alias("differing"), F.lit(len(store.stored_models(g.spark, root))).cast("long").alias("models_kept")
    )


@query("raw_to_graph")
def _(g):
    """All ten raw datasets through parsing, resolution, checks and the store."""
    return graph.graph_summary(raw_graph(g).edges())


def raw_graph(g: DerivedGraph) -> EntityGraph:
    # the test lines hold broken ones and unknown ids on purpose
    return EntityGraph.open(g.spark, write_raw(g, *RAW_DATASETS), new_path(g.spark, "graph"), tolerance=1 << 40)


@query("raw_to_graph_drops")
def _(g):
    """What the same build set aside, by dataset."""
    return raw_graph(g).drops()


# ---- text and scalar functions -------------------------------------------

@query("author_id")
def _(g):
    names = g.authors.select(F.col("idx").alias("src"), "fullname")
    pubs = F.concat(F.lit("p"), F.col("dst").cast("string")).alias("pub_id")
    return (
        g.writes.join(names, "src").select("src", "dst", "fullname", pubs)
        .select("src", "dst", text.author_id("fullname", "pub_id").alias("author_id"))
    )


@query("lnfi_key")
def _(g):
    return g.authors.select("idx", text.lnfi_key("name", "surname").alias("key"))


@query("wellformed_authors")
def _(g):
    return g.authors.where(text.is_wellformed("name", "surname")).select("idx", "name", "surname")


@query("replace_char")
def _(g):
    pos = (F.col("c_custkey") % 42 - 21).cast("int")
    return g.table("customer").select(
        F.col("c_custkey").alias("idx"), text.replace_char("c_name", pos, "<>").alias("replaced")
    )


@query("author_display")
def _(g):
    return g.authors.withColumn("orcid", _gapped()).select(
        "idx", text.author_display("fullname", "orcid").alias("shown")
    )


@query("prune_edges")
def _(g):
    return metrics.prune_edges(sim_scored(g), 0.5)


@query("binarise_scores")
def _(g):
    return metrics.binarise(sim_scored(g))


@query("extreme_edges_high")
def _(g):
    return metrics.extreme_edges(sim_scored(g), g.authors, is_above("score", 0.95))


@query("extreme_edges_low")
def _(g):
    return metrics.extreme_edges(sim_scored(g), g.authors, F.col("score") < 0.35)


# ---- joins and lookups ---------------------------------------------------

def _register_resolution(etype: str) -> None:
    @query(f"resolve_{etype}")
    def _(g):
        kind = EDGE_TYPES[etype]
        return graph.resolve_edges(
            g.raw_edges(etype), node_ids(g, kind.src_type), node_ids(g, kind.dst_type)
        )


for _etype, _kind in EDGE_TYPES.items():
    if _kind.dataset:
        _register_resolution(_etype)


@query("resolve_all_relations")
def _(g):
    relations = {t: g.raw_edges(t) for t, kind in EDGE_TYPES.items() if kind.dataset}
    resolved = graph.resolve_relations(relations, node_ids(g, AUTHOR), node_ids(g, PUBLICATION))
    return resolved.groupBy("etype").agg(
        F.count(F.lit(1)).alias("edges"), F.sum("src").alias("src_sum"), F.sum("dst").alias("dst_sum")
    )


@query("unresolved_edge_report")
def _(g):
    return graph.unresolved_report(
        g.raw_edges("writes"), node_ids(g, AUTHOR), node_ids(g, PUBLICATION)
    )


@query("label_candidates")
def _(g):
    return candidates_with_copies(g)


@query("orcid_labels")
def _(g):
    numbered = labels.orcid_labels(g.authors.select("idx", _gapped().alias("orcid")))
    return labels.require_label_per_node(numbered, g.num_authors)


# ---- blocks --------------------------------------------------------------

@query("pair_counts")
def _(g):
    return blocking.pair_counts(g.authors, "block", "orcid")


@query("block_count")
def _(g):
    return blocking.block_count(g.authors, "block")


@query("label_sketches")
def _(g):
    """Distinct blocks and rows of each market, from sketches stored by market
    and nation: the exact count, and whether the estimate is within 2 %."""
    by_part = materialise(sketches.label_sketches(g.authors, "block", "c_mktsegment", "c_nationkey"), "label-sketches")
    found = sketches.estimated_labels(by_part, "c_mktsegment")
    exact = g.authors.groupBy("c_mktsegment").agg(F.count_distinct("block").alias("blocks"))
    near = F.abs(F.col("labels") - F.col("blocks")) <= 0.02 * F.col("blocks")
    return found.join(exact, "c_mktsegment").select("c_mktsegment", "rows", "blocks", near.alias("within_2_percent"))


@query("dense_index")
def _(g):
    return ordering.dense_index(g.authors.select("idx", _gapped().alias("orcid")), "orcid")


@query("block_size_histogram")
def _(g):
    return blocking.block_size_histogram(g.authors, "orcid")


@query("singleton_blocks")
def _(g):
    return blocking.singleton_blocks(connected_components(g.authors, linked(g)), "component")


@query("reduction_ratio")
def _(g):
    return blocking.reduction_ratio(g.authors, "block")


@query("author_stats")
def _(g):
    return blocking.author_stats(g.authors.select("idx", _gapped().alias("orcid")), "orcid")


@query("cluster_noise_stats")
def _(g):
    points = g.table("embeddings").select(
        F.when(F.col("vec_id") % 10 == 0, -1).otherwise(F.col("label")).alias("cluster"),
        (F.col("vec_id") % 3 != 0).alias("is_core"),
    )
    return blocking.cluster_noise_stats(points, "cluster", "is_core")


@query("simrel_counts")
def _(g):
    return metrics.simrel_counts(candidates_with_copies(g))


@query("pairwise_prf")
def _(g):
    return blocking.pairwise_prf(g.authors, "orcid", "block")


@query("blocking_quality")
def _(g):
    return blocking.blocking_quality(g.authors, "orcid", "block")


@query("blocking_report")
def _(g):
    return blocking.blocking_report(g.authors, "orcid", "block")


@query("blocking_report_lnfi")
def _(g):
    keyed = g.authors.withColumn("key", text.lnfi_key("name", "surname"))
    return blocking.blocking_report(keyed, "orcid", "key")


@query("blocking_report_documents")
def _(g):
    docs = g.table("documents").select(F.md5("text").alias("copy"), "source")
    return blocking.blocking_report(docs, "copy", "source")


# ---- scored edges --------------------------------------------------------

@query("scored_union")
def _(g):
    scored = sim_labelled(g)
    return metrics.scored_union(scored.where("label = 1"), scored.where("label = 0"))


@query("confusion_matrix")
def _(g):
    return metrics.confusion_matrix(sim_labelled(g))


@query("confusion_metrics")
def _(g):
    return metrics.confusion_metrics(metrics.confusion_counts(sim_labelled(g)))


@query("round_accuracy")
def _(g):
    return metrics.round_accuracy(sim_labelled(g))


@query("roc_auc")
def _(g):
    return metrics.roc_auc(sim_labelled(g))


@query("bce_loss")
def _(g):
    return metrics.bce_loss(sim_labelled(g))


@query("bce_logits_loss")
def _(g):
    return metrics.bce_logits_loss(sim_labelled(g).withColumn("logit", (F.col("score") - 0.5) * 10))


@query("margin_loss")
def _(g):
    drawn = labels.negative_edges(sim_scored(g).withColumnRenamed("score", "pos_score"), 2, g.num_authors)
    negatives = drawn.select("src", F.col("neg_dst").alias("dst"), "pos_score")
    return metrics.margin_loss(g.cosine_scores(negatives).withColumnRenamed("score", "neg_score"))


@query("contrastive_loss")
def _(g):
    return metrics.contrastive_loss(sim_labelled(g).withColumn("distance", 1 - F.col("score")))


@query("threshold_stats")
def _(g):
    edges = linked(g)
    return sweep.threshold_stats(edges, g.equates, identities(g), connected_components(g.authors, edges))


def full_sweep(g: DerivedGraph) -> DataFrame:
    return sweep.threshold_sweep(g.cosine_scores(g.similar_for_dedup), g.equates, identities(g))


@query("threshold_sweep")
def _(g):
    return full_sweep(g)


@query("threshold_sweep_long")
def _(g):
    return sweep.sweep_long(full_sweep(g))


@query("sweep_header")
def _(g):
    return sweep.sweep_header(g.similar_for_dedup, identities(g))


@query("best_threshold")
def _(g):
    return sweep.best_threshold(full_sweep(g))


@query("cosine_scores")
def _(g):
    return sim_scored(g)


@query("inspection_report")
def _(g):
    return inspect.inspection_report(sim_scored(g), g.equates, g.authors, 0.99, 0.35)


# ---- order, splits, negatives --------------------------------------------

@query("global_index")
def _(g):
    rows = g.table("customer").select(F.col("c_custkey").alias("idx"), "c_acctbal")
    return ordering.positional_index(rows, ["c_acctbal", "idx"]).select("idx", "position")


@query("balanced_edges")
def _(g):
    return labels.balanced_edges(candidates_with_copies(g))


@query("split_leakage")
def _(g):
    return labels.split_leakage(labels.edge_splits(candidates_with_copies(g)))


def candidates_both_ways(g: DerivedGraph) -> DataFrame:
    """Candidates with copies, and some of them in the other direction as well."""
    edges = g.similar
    again = edges.where("src % 5 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return labels.label_candidates(edges.unionByName(edges.where("src % 7 = 0")).unionByName(again), g.equates)


@query("grouped_splits")
def _(g):
    return labels.grouped_splits(candidates_both_ways(g))


@query("grouped_split_sizes")
def _(g):
    return labels.split_sizes(labels.grouped_splits(candidates_both_ways(g)))


@query("grouped_split_leakage")
def _(g):
    """No pair is in two splits."""
    return labels.split_leakage(labels.grouped_splits(candidates_both_ways(g)))


@query("evaluate_test_split")
def _(g):
    """Loss, accuracy and confusion cells of the cosine scores on the test split."""
    tested = labels.edge_splits(candidates_with_copies(g)).where("split = 'test'")
    scored = labels.expand_copies(tested.join(plain(sim_scored(g)), ["src", "dst"]))
    return train.evaluation(materialise(scored.select("label", "score"), "test-scores"))


@query("edge_splits")
def _(g):
    return labels.edge_splits(candidates_with_copies(g))


@query("split_sizes")
def _(g):
    return labels.split_sizes(labels.edge_splits(candidates_with_copies(g)))


@query("negative_edges")
def _(g):
    return labels.negative_edges(g.similar, 3, g.num_authors)


@query("reverse_edges")
def _(g):
    return graph.reverse_edges(g.writes)


# ---- graph ---------------------------------------------------------------

@query("graph_summary")
def _(g):
    return graph.graph_summary(graph.edge_table(all_edges(g)))


@query("degree_stats")
def _(g):
    return graph.degree_stats(graph.edge_table(all_edges(g)))


@query("graph_integrity")
def _(g):
    nodes = {AUTHOR: g.author_features, PUBLICATION: g.publication_features}
    report = graph.integrity_report(nodes, graph.edge_table(all_edges(g)))
    graph.require_intact(report)
    return report


@query("graph_integrity_broken")
def _(g):
    """The report on a graph with a doubled node, a gap, a short vector, and
    edges below and above the range."""
    odd = g.author_features.where("idx < 5").union(g.author_features.where("idx > 9")).withColumn(
        "feat", F.when(F.col("idx") == 12, F.slice("feat", 1, 3)).otherwise(F.col("feat"))
    )
    nodes = {AUTHOR: odd.union(odd.where("idx IN (1, 2)")), PUBLICATION: g.publication_features}
    similar = graph.edge_table({"similar": g.similar})
    below = similar.where("src % 11 = 0").select("etype", (-1 - F.col("src")).alias("src"), "dst")
    return graph.integrity_report(nodes, similar.unionByName(below))


def _register_subgraph(etype: str) -> None:
    @query(f"subgraph_{etype}")
    def _(g):
        return graph.subgraph(graph.edge_table(all_edges(g)), etype)


for _etype in ("potentially_equates", "collaborates", "similar", "equates", "similar_for_dedup"):
    _register_subgraph(_etype)


@query("metapath_colleague")
def _(g):
    return graph.metapath(path_edges(g, "colleague"), VIEWS["colleague"])


@query("metapath_citation")
def _(g):
    return graph.metapath(path_edges(g, "citation"), VIEWS["citation"])


@query("view_with_self_loops")
def _(g):
    return graph.with_self_loops(graph.metapath(path_edges(g, "citation"), VIEWS["citation"]), g.authors)


def views(g: DerivedGraph) -> DataFrame:
    """The author views as a stored table, as every consumer reads them more than once."""
    return materialise(graph.author_views(path_edges(g), g.authors), "views")


@query("author_views")
def _(g):
    return graph.author_views(path_edges(g), g.authors).groupBy("view").agg(
        F.count(F.lit(1)).alias("edges"), F.sum("w").alias("weight"), F.max("w").alias("max_weight")
    )


@query("components_by_batches")
def _(g):
    """The same components from five batches of edges, each contracted with the
    labels stored before."""
    store = ComponentStore(g.spark, new_path(g.spark, "components"))
    edges = materialise(linked(g).select("src", "dst"), "linked")
    for k in range(5):
        store.add(edges.where(F.pmod(F.hash("src", "dst"), F.lit(5)) == k))
    return g.authors.select("idx").join(store.labels(), "idx", "left").select("idx", F.coalesce("component", "idx").alias("component"))


@query("connected_components")
def _(g):
    return connected_components(g.authors, linked(g))


# ---- embeddings, scoring, training ---------------------------------------

def vector_digest(df: DataFrame, *keys: str) -> DataFrame:
    """First element, sum, and sum weighted by place of a vector column."""
    vec = F.col("vec").cast("array<double>")
    total = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x)
    placed = F.aggregate(F.transform(vec, lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return df.select(*keys, F.element_at(vec, 1).alias("first"), F.round(total, 4).alias("total"), F.round(placed, 2).alias("placed"))


@query("neighbour_mean")
def _(g):
    found = embed.neighbour_mean(views(g), node_vectors(g), 64)
    return vector_digest(found, "view", "idx")


@query("neighbour_mean_stored")
def _(g):
    """The same from a stored graph: views bucketed by source, vectors by node."""
    stored = store.GraphStore(g.spark, new_path(g.spark, "graph"))
    stored.save({AUTHOR: g.author_features.select("idx")}, graph.edge_table({"similar": g.similar}))
    by_src = stored.bucketed("views", "src", lambda: graph.author_views(path_edges(g), g.authors))
    vectors = stored.bucketed("features", "idx", lambda: node_vectors(g))
    return vector_digest(embed.neighbour_mean(by_src, vectors, 64), "view", "idx")


@query("neighbour_mean_wide")
def _(g):
    """Vectors of 768, as in the original experiments: the features twelve
    times, times 1 to 12."""
    blocks = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.transform("feat", lambda x: x * k))
    wide = g.author_features.select("idx", F.flatten(blocks).alias("vec"))
    return vector_digest(embed.neighbour_mean(views(g), wide, 768), "view", "idx")


def node_vectors(g: DerivedGraph) -> DataFrame:
    return g.author_features.select("idx", F.col("feat").alias("vec"))


def small_weights() -> embed.ScorerWeights:
    return embed.formula_weights(64, 8)


@query("sage_layer")
def _(g):
    first = {v: pair[0] for v, pair in small_weights().layers.items()}
    return vector_digest(embed.sage_layer(embed.mean_shares(views(g)), node_vectors(g), first), "view", "idx")


def embedded(g: DerivedGraph) -> DataFrame:
    return embed.view_embeddings(embed.mean_shares(views(g)), node_vectors(g), small_weights())


@query("view_embeddings")
def _(g):
    return vector_digest(embedded(g), "view", "idx")


@query("view_attention")
def _(g):
    return embed.view_attention(embedded(g))


@query("node_embeddings")
def _(g):
    return vector_digest(embed.node_embeddings(embedded(g), 8), "idx")


@query("edge_scores")
def _(g):
    return embed.score_candidates(g.similar, views(g), node_vectors(g), small_weights())


def training_table(g: DerivedGraph) -> DataFrame:
    def reduced() -> tuple[DataFrame, PipelineModel]:
        features = materialise(node_vectors(g), "features")  # the reducer reads them several times
        return features, train.fit_reducer(features, 8)

    # none of the three needs another
    made = at_once({"splits": lambda: labels.edge_splits(labels.label_candidates(g.similar, g.equates)), "views": lambda: views(g), "reduced": reduced})
    return train.training_vectors(made["splits"], train.node_vectors(made["views"], *made["reduced"]))


def trained(g: DerivedGraph) -> tuple[train.TrainedScorer, DataFrame]:
    vectors = training_table(g)
    root = new_path(g.spark, "training")
    return train.train_edge_scorer(vectors, root, "run", hidden=16, rounds=12, iterations=10, patience=3), vectors


@query("resumed_run")
def _(g):
    """A run cut off after three rounds and taken up again, next to one without
    the cut: metrics of each round, those that differ, and whether both keep the
    same round's model."""
    vectors, root = training_table(g), new_path(g.spark, "training")
    options = {"hidden": 8, "iterations": 5, "patience": 100}
    edges = train.PackedEdges.of(vectors)
    whole = train.train_edge_scorer(edges, root, "whole", rounds=6, **options)
    train.train_edge_scorer(edges, root, "cut", rounds=3, **options)
    again = train.train_edge_scorer(edges, root, "cut", rounds=6, **options)
    edges.release()
    same = whole.model_path.rsplit("/", 1)[1] == again.model_path.rsplit("/", 1)[1]
    keys = ["epoch", "split", "metric"]
    other = again.metrics(g.spark).select(*keys, F.col("value").alias("resumed"))
    both = whole.metrics(g.spark).join(other, keys, "full")
    differs = F.coalesce(F.abs(F.col("value") - F.col("resumed")) > 1e-6, F.lit(True))
    return both.groupBy("epoch").agg(
        F.count(F.lit(1)).alias("metrics"), F.count_if(differs).alias("differing"), F.lit(same).alias("same_model")
    )


@query("train_edge_scorer")
def _(g):
    """Facts that hold for every run: the kept round has the smallest loss, the
    loss fell, and training stopped in time."""
    scorer, _vectors = trained(g)
    kept = int(scorer.model_path.rsplit("epoch", 1)[1])
    valid = scorer.metrics(g.spark).where("split = 'valid' AND metric = 'loss'")
    return valid.agg(
        (F.min("value") == F.min(F.when(F.col("epoch") == kept, F.col("value")))).alias("kept_is_best"),
        (F.min("value") < F.min(F.when(F.col("epoch") == 1, F.col("value")))).alias("loss_fell"),
        ((F.max("epoch") == 12) | (F.max("epoch") == kept + 2)).alias("stopped_in_time"),
    )


@query("training_metrics")
def _(g):
    """Rounds that do not have four finite values; rounds are numbered from 1."""
    rounds = trained(g)[0].metrics(g.spark).groupBy("epoch").agg(F.count_if(F.abs("value") < float("inf")).alias("n"))
    return rounds.agg(F.count_if(F.col("n") != 4).alias("incomplete"), (F.min("epoch") == 1).alias("from_one"), (F.max("epoch") == F.count(F.lit(1))).alias("no_gap"))


@query("evaluate_edge_scorer")
def _(g):
    """Test edges per class, from the confusion cells."""
    cells = {r["metric"]: r["value"] for r in train.evaluate_edge_scorer(*trained(g)).collect()}  # six rows
    rows = [(0, int(cells["tn"] + cells["fp"])), (1, int(cells["fn"] + cells["tp"]))]
    return g.spark.createDataFrame(rows, "label int, edges bigint")
