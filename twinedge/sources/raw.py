"""Raw text datasets: one Python tuple per line, possibly gzipped.

Lines are never evaluated. Tuples in either quote style, with escaped quotes and
backslashes inside, are taken apart in the JVM; only lines with other escapes
and malformed ones are sent to Python, where ``ast.literal_eval`` reads them.
"""

from __future__ import annotations

import ast
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinedge.schema import (
    AUTHOR,
    AUTHOR_PAYLOAD,
    FEATURE_FIELD,
    NODE_DATASETS,
    PUBLICATION_PAYLOAD,
    RAW_DATASETS,
)
from twinedge.scratch import swept

_ONE = r"""'([^'\\]*)'"""
_TWO = r'''"([^"\\]*)"'''
PLAIN_EDGE = rf"^\((?:{_ONE}|{_TWO}), (?:{_ONE}|{_TWO})\)$"
PLAIN_NODE = rf"^\((?:{_ONE}|{_TWO}), \d{{1,18}}\)$"
# escapes that are taken apart in the JVM, each by a character that stands in for it
ESCAPES = (("\\\\", "\x01", "\\"), ("\\'", "\x02", "'"), ('\\"', "\x03", '"'))

# as objects: a type string would need a running session at import
EDGE_STRUCT = T.StructType([T.StructField("first", T.StringType()), T.StructField("second", T.StringType())])
NODE_STRUCT = T.StructType([T.StructField("first", T.StringType()), T.StructField("second", T.LongType())])


def _literal_pair(lines: pd.Series, second: type) -> pd.DataFrame:
    def parse(line):
        if line is None:
            return None, None
        try:
            first, other = ast.literal_eval(line)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None, None
        if not isinstance(first, str) or not isinstance(other, second) or isinstance(other, bool):
            return None, None
        try:
            for text in (first, other):
                if isinstance(text, str):
                    text.encode()  # a lone surrogate is no text
        except UnicodeEncodeError:
            return None, None
        if isinstance(other, int) and not -(1 << 63) <= other < 1 << 63:
            return None, None
        return first, other

    return pd.DataFrame([parse(line) for line in lines], columns=["first", "second"], dtype=object)


@F.pandas_udf(EDGE_STRUCT)
def literal_edge(lines: pd.Series) -> pd.DataFrame:
    return _literal_pair(lines, str)


@F.pandas_udf(NODE_STRUCT)
def literal_node(lines: pd.Series) -> pd.DataFrame:
    return _literal_pair(lines, int)


def _sheltered(line: Column) -> Column:
    """The line with each simple escape replaced by its stand-in; from left to
    right, so a backslash that is escaped itself escapes nothing."""
    for escape, stand_in, _ in ESCAPES:
        line = F.replace(line, F.lit(escape), F.lit(stand_in))
    return line


def _restored(text: Column) -> Column:
    for _, stand_in, meant in ESCAPES:
        text = F.replace(text, F.lit(stand_in), F.lit(meant))
    return text


def _pairs(lines: DataFrame, plain: str, literal, first: Column, second: Column, kind: str) -> DataFrame:
    """``line, first, second``; both null where the line is not such a tuple.

    ``first`` and ``second`` take apart the sheltered line ``s``.
    """
    # a line with a stand-in of its own, or other escapes, goes to Python; the
    # others reach it as nulls, which cost next to nothing
    foreign = F.col("line").rlike("[\x01-\x03]")
    held = lines.select(F.col("value").alias("line")).withColumn("s", _sheltered(F.col("line")))
    parsed = held.withColumn("simple", ~foreign & F.col("s").rlike(plain)).withColumn(
        "parsed", literal(F.when(~F.col("simple"), F.col("line")))
    )
    return parsed.select(
        "line",
        F.when(F.col("simple"), _restored(first)).otherwise(F.col("parsed.first")).alias("first"),
        F.when(F.col("simple"), second).otherwise(F.col("parsed.second")).cast(kind).alias("second"),
    )


def parse_edges(lines: DataFrame) -> DataFrame:
    """``line, src_id, dst_id``; ids are null on a malformed line."""
    def part(one: int) -> Column:
        return F.concat(F.regexp_extract("s", PLAIN_EDGE, one), F.regexp_extract("s", PLAIN_EDGE, one + 1))

    return _pairs(lines, PLAIN_EDGE, literal_edge, part(1), _restored(part(3)), "string").withColumnsRenamed({"first": "src_id", "second": "dst_id"})


def parse_nodes(lines: DataFrame, ntype: str, only: tuple[str, ...] = ()) -> DataFrame:
    """``line, idx`` and the typed payload; ``idx`` and ``id`` are null on a bad line.

    A missing ORCID reads as '', a JSON null stays null: two different labels.
    With ``only`` the other payload fields, such as the vectors, are not parsed.
    """
    schema = AUTHOR_PAYLOAD if ntype == AUTHOR else PUBLICATION_PAYLOAD
    if only:
        schema = T.StructType([f for f in schema.fields if f.name in ("id", *only)])
    rows = _node_pairs(lines)
    rows = rows.withColumn("data", F.from_json("payload", schema))
    fields = [F.col(f"data.{f.name}").alias(f.name) for f in schema.fields if f.name != "orcid"]
    if "orcid" in schema.names:
        fields.append(_orcid().alias("orcid"))
    return rows.select("line", "idx", *fields).withColumnRenamed(FEATURE_FIELD[ntype], "feat")


def _node_pairs(lines: DataFrame) -> DataFrame:
    """``line, payload, idx`` of node lines."""
    # ('payload', index): cut by place, the shape is known
    tail = F.substring_index("s", ", ", -1)
    index = F.rtrim(tail, F.lit(")")).try_cast("long")
    payload = F.substr("s", F.lit(3), F.length("s") - F.length(tail) - 5)
    return _pairs(lines, PLAIN_NODE, literal_node, payload, index, "long").withColumnsRenamed({"first": "payload", "second": "idx"})


def node_faults(lines: DataFrame, size: int | None = None) -> DataFrame:
    """``(line, reason)`` of the node lines ``lines(value)`` that cannot be used.

    The payload is read as a VARIANT. Reasons, the first that holds:
    ``no tuple``, ``bad JSON``, ``no object``, ``no id``, and ``index out of
    range`` (negative, beyond 64 bits, or not below ``size`` if that is given).
    A null line is no tuple.
    """
    rows = _node_pairs(lines).withColumn("data", F.try_parse_json("payload"))
    # a tuple whose index does not fit is read as no tuple
    too_large = F.coalesce(F.col("line").rlike(r"(?s)^\(.*, -?\d{19,}\)$"), F.lit(False))
    outside = F.col("idx") < 0 if size is None else ~F.col("idx").between(0, size - 1)
    kind = F.schema_of_variant("data")
    reason = (
        F.when(F.col("idx").isNull(), F.when(too_large, "index out of range").otherwise("no tuple"))
        .when(F.col("data").isNull(), "bad JSON")
        .when(~kind.startswith("OBJECT"), "no object")
        .when(F.try_variant_get("data", "$.id", "string").isNull(), "no id")
        .when(outside, "index out of range")
    )
    return rows.select("line", reason.alias("reason")).where("reason IS NOT NULL")


def edge_faults(lines: DataFrame) -> DataFrame:
    """``(line, reason)`` of edge lines that are no pair of texts (``no tuple``)."""
    return quarantine(parse_edges(lines)).select("line", F.lit("no tuple").alias("reason"))


def _orcid() -> Column:
    # the keys are listed only for the few payloads without a value that do
    # mention the key
    mentioned = F.col("payload").contains('"orcid"')
    is_null = mentioned & F.array_contains(F.json_object_keys("payload"), "orcid")
    return F.when(F.col("data.orcid").isNotNull(), F.col("data.orcid")).when(is_null, F.lit(None)).otherwise("")


def well_formed(parsed: DataFrame) -> DataFrame:
    return parsed.where(_good(parsed)).drop("line")


def quarantine(parsed: DataFrame) -> DataFrame:
    """The lines that could not be read."""
    return parsed.where(~_good(parsed)).select("line")


def sifted(parsed: DataFrame) -> DataFrame:
    """Parsed rows with ``line`` kept only where it could not be read, so one
    written table serves both :func:`well_formed` and :func:`quarantine`."""
    return parsed.withColumn("line", F.when(~_good(parsed), F.col("line")))


def _good(parsed: DataFrame) -> Column:
    needed = ("idx", "id") if "idx" in parsed.columns else ("src_id", "dst_id")
    return F.col(needed[0]).isNotNull() & F.col(needed[1]).isNotNull()


def scan_nodes(spark: SparkSession, raw_dir: str, ntype: str, only: tuple[str, ...] = ()) -> DataFrame:
    return well_formed(parse_nodes(spark.read.text(f"{raw_dir}/{NODE_DATASETS[ntype]}"), ntype, only))


def scan_edges(spark: SparkSession, raw_dir: str, dataset: str) -> DataFrame:
    return well_formed(parse_edges(spark.read.text(f"{raw_dir}/{dataset}")))


def author_orcids(spark: SparkSession, raw_dir: str) -> DataFrame:
    """``(idx, orcid)`` of all author lines."""
    return scan_nodes(spark, raw_dir, AUTHOR, only=("orcid",)).select("idx", "orcid")


def dataset_completeness(spark: SparkSession, raw_dir: str) -> DataFrame:
    """``(dataset, ok, rows)`` for the ten raw datasets: it exists, holds a
    line, and how many lines it holds (all are counted, in one job)."""
    found, counts = [], []
    for name in RAW_DATASETS:
        try:
            lines = spark.read.text(f"{raw_dir}/{name}")
        except AnalysisException:
            continue
        found.append(name)
        counts.append(lines.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("dataset"), "rows"))
    names = spark.createDataFrame([(n,) for n in RAW_DATASETS], "dataset string")
    if not found:
        return names.select("dataset", F.lit(False).alias("ok"), F.lit(0).cast("long").alias("rows"))
    counted = names.join(reduce(DataFrame.unionByName, counts), "dataset", "left")
    rows = F.coalesce("rows", F.lit(0).cast("long"))
    return counted.select("dataset", (rows > 0).alias("ok"), rows.alias("rows"))


def missing_datasets(spark: SparkSession, raw_dir: str) -> list[str]:
    """Those of the ten raw datasets that do not exist or hold no line; reads a
    line of each."""
    missing = []
    for name in RAW_DATASETS:
        try:
            empty = spark.read.text(f"{raw_dir}/{name}").isEmpty()
        except AnalysisException:
            empty = True
        if empty:
            missing.append(name)
    return missing


def write_json_gz(df: DataFrame, path: str) -> None:
    """JSON lines, gzipped, non-ASCII letters kept, null fields written."""
    df.write.option("compression", "gzip").option("ignoreNullFields", "false").json(path)


# ---- writing the raw format ----------------------------------------------

def python_quoted(text: Column) -> Column:
    """A Python string literal in single quotes."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), escaped, F.lit("'"))


def edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.concat(F.lit("("), python_quoted(F.col("src_id")), F.lit(", "), python_quoted(F.col("dst_id")), F.lit(")")).alias("value")
    )


def node_lines(nodes: DataFrame, payload: Column) -> DataFrame:
    return nodes.select(
        F.concat(F.lit("("), python_quoted(payload), F.lit(", "), F.col("idx").cast("string"), F.lit(")")).alias("value")
    )


# most of the text is decimal digits, which short matches only lengthen
GZIP = {"compression": "gzip", "zlib.compress.level": "FOUR", "zlib.compress.strategy": "FILTERED"}


def write_lines(lines: DataFrame, raw_dir: str, dataset: str) -> None:
    with swept(lines.sparkSession):
        lines.write.options(**GZIP).text(f"{raw_dir}/{dataset}")
