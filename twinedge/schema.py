"""Data model: node tables, edge tables and the edge-type catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

AUTHOR = "author"
PUBLICATION = "publication"


@dataclass(frozen=True)
class EdgeType:
    src_type: str
    dst_type: str
    dataset: str | None  # raw dataset it is read from; None for a derived type


# Names of the raw datasets and of the edge types they become.
EDGE_TYPES = {
    "cites": EdgeType(PUBLICATION, PUBLICATION, "cites_rels"),
    "collaborates": EdgeType(AUTHOR, AUTHOR, "collaborates_rels"),
    "coprojected": EdgeType(PUBLICATION, PUBLICATION, "coprojected_rels"),
    "writes": EdgeType(AUTHOR, PUBLICATION, "writes_rels"),
    "is_written_by": EdgeType(PUBLICATION, AUTHOR, None),
    "potentially_equates": EdgeType(AUTHOR, AUTHOR, "potentiallyequivalent_rels"),
    "equates": EdgeType(AUTHOR, AUTHOR, "equivalent_rels"),
    "similar": EdgeType(AUTHOR, AUTHOR, "simrels"),
    "similar_for_dedup": EdgeType(AUTHOR, AUTHOR, "simrels_dedup"),
}
NODE_DATASETS = {AUTHOR: "authors", PUBLICATION: "publications"}
RAW_DATASETS = [*NODE_DATASETS.values(), *(e.dataset for e in EDGE_TYPES.values() if e.dataset)]

# The four author views and how each is made.
VIEWS = {
    "potentially_equates": ["potentially_equates"],
    "colleague": ["writes", "coprojected", "is_written_by"],
    "citation": ["writes", "cites", "is_written_by"],
    "collaboration": ["collaborates"],
}

# Fields of the JSON payload of a raw node line.
AUTHOR_PAYLOAD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("fullname", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("surname", T.StringType()),
        T.StructField("orcid", T.StringType()),
        T.StructField("pub_embedding", T.ArrayType(T.FloatType())),
    ]
)
PUBLICATION_PAYLOAD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("bert_embedding", T.ArrayType(T.FloatType())),
    ]
)
FEATURE_FIELD = {AUTHOR: "pub_embedding", PUBLICATION: "bert_embedding"}

# Evaluation and training defaults.
THRESHOLDS = tuple(i / 10 for i in range(11))
CUT_THRESHOLD = 0.5
EXAMPLES = 3
SURELY_RIGHT = 0.99
SURELY_WRONG = 0.00001
TRAIN_RATIO = 0.6
VALID_RATIO = 0.2
EARLY_STOPPING = 40
EPOCHS = 800
LEARNING_RATE = 0.001
HIDDEN_WIDTH = 100
