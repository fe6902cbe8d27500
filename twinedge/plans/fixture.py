"""A heterogeneous graph derived from the TPC-H-like test tables.

Customers play author records, orders play publications. Sizes follow from the
data: N authors, P = N div 3 planted persons, K = N div 12 blocks, V vectors.
Groups whose pairs are linked are bounded by construction: about 3 records per
person, 12 per block, at most 2 authors per publication. Groups the data alone
bounds (orders of one day, customers of one market, lines of one part) are
linked as stars on their smallest member, so no relation grows faster than its
table even where one group holds a third of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinedge.operators.embed import cosine_scores
from twinedge.schema import EDGE_TYPES
from twinedge.scratch import materialise

# Names with the letters and gaps that the text helpers must handle.
SURNAMES = ["Müller", "Ångström", "O'Neil", "Strauß", "Núñez", "Çelik", "Łukasz", "Ærø", "Smith", "Dvořák", "İnan"]
GIVEN = ["Ána", "Björn", "čeněk", "Dana", "Élodie", "øystein", "Zoë"]


def star(df: DataFrame, group: list[str], member: str) -> DataFrame:
    """(first, member) for every member but the first of its group.

    Most groups may have one member or two, whose link shows in the group's ends:
    only the members of larger groups are looked up.
    """
    ends = df.groupBy(*group).agg(F.min(member).alias("first"), F.max(member).alias("last"), F.count(member).alias("n"))
    linked = materialise(ends.where("first < last").where(" AND ".join(f"{g} IS NOT NULL" for g in group)), "stars")
    pairs = linked.where("n = 2").select("first", F.col("last").alias(member))
    firsts = materialise(linked.where("n > 2").drop("last", "n"), "stars-of-many")
    return pairs.unionByName(df.join(firsts, group).where(F.col("first") < F.col(member)).select("first", member))


def pick(values: list[str], position):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (position % len(values)).cast("int") + 1)


@dataclass
class DerivedGraph:
    spark: SparkSession
    sf_dir: str

    _read: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._read[name]

    @cached_property
    def num_authors(self) -> int:
        return self.table("customer").count()

    @cached_property
    def num_vectors(self) -> int:
        return self.table("embeddings").count()

    @property
    def num_persons(self) -> int:
        return self.num_authors // 3

    @property
    def num_blocks(self) -> int:
        return self.num_authors // 12

    @cached_property
    def authors(self) -> DataFrame:
        """idx, id, person, block, names, orcid and the market columns; no features."""
        person = F.col("c_custkey") % self.num_persons
        idx = F.col("c_custkey")
        return self.table("customer").select(
            idx.alias("idx"),
            F.concat(F.lit("a"), idx.cast("string")).alias("id"),
            person.alias("person"),
            (person % self.num_blocks).alias("block"),
            F.when(idx % 97 == 13, F.lit(""))
            .when(idx % 101 == 3, F.lit(None))
            .otherwise(pick(GIVEN, idx))
            .alias("name"),
            F.when(idx % 89 == 7, F.lit("")).otherwise(pick(SURNAMES, person)).alias("surname"),
            F.concat(pick(SURNAMES, person), F.lit(", "), pick(GIVEN, idx)).alias("fullname"),
            F.when(person % 211 == 5, F.lit(""))
            .otherwise(F.concat(F.lit("0000-"), F.lpad(person.cast("string"), 8, "0")))
            .alias("orcid"),
            "c_nationkey",
            "c_mktsegment",
            "c_acctbal",
        )

    @cached_property
    def author_features(self) -> DataFrame:
        """(idx, feat): two vectors mixed, so records of one person are close."""
        vectors = self.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
        person = F.col("c_custkey") % self.num_persons
        return (
            self.table("customer")
            .select(
                F.col("c_custkey").alias("idx"),
                (person % self.num_vectors).alias("v1"),
                (
                    (F.col("c_custkey") * 7 + 3 + 11 * F.expr(f"c_custkey div {self.num_persons}"))
                    % self.num_vectors
                ).alias("v2"),
            )
            # few bytes a row, so one task may read them all, but long vectors to make
            .repartition(self.spark.sparkContext.defaultParallelism, "idx")
            .join(vectors.withColumnsRenamed({"vec_id": "v1", "e": "e1"}), "v1")
            .join(vectors.withColumnsRenamed({"vec_id": "v2", "e": "e2"}), "v2")
            .select(
                "idx", F.zip_with("e1", "e2", lambda a, b: F.lit(0.7) * a + F.lit(0.3) * b).alias("feat")
            )
        )

    @cached_property
    def publications(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").select(
            key.alias("idx"), F.concat(F.lit("p"), key.cast("string")).alias("id")
        )

    def with_vectors(self, made: Column) -> DataFrame:
        """(idx, feat): ``made`` from the column feat of a publication's vector,
        once for each vector."""
        vectors = self.table("embeddings").select("vec_id", F.col("embedding").alias("feat"))
        return (
            self.table("orders")
            .select(F.col("o_orderkey").alias("idx"), (F.col("o_orderkey") % self.num_vectors).alias("vec_id"))
            .join(vectors.select("vec_id", made), "vec_id")
            .select("idx", "feat")
        )

    @cached_property
    def publication_features(self) -> DataFrame:
        return self.with_vectors(F.col("feat"))

    @cached_property
    def writes(self) -> DataFrame:
        second = F.col("o_orderkey") % self.num_authors
        return (
            self.table("orders")
            .select(
                F.explode(F.array_distinct(F.array("o_custkey", second))).alias("src"),
                F.col("o_orderkey").alias("dst"),
            )
        )

    @cached_property
    def cites(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
        return (
            star(lines, ["l_partkey", "l_suppkey"], "l_orderkey")
            .select(F.col("l_orderkey").alias("src"), F.col("first").alias("dst"))
            .distinct()
        )

    @cached_property
    def coprojected(self) -> DataFrame:
        return star(
            self.table("orders"), ["o_orderdate", "o_orderpriority", "o_orderstatus"], "o_orderkey"
        ).select(F.col("first").alias("src"), F.col("o_orderkey").alias("dst"))

    @cached_property
    def collaborates(self) -> DataFrame:
        """Both directions between the (at most two) authors of an order."""
        second = F.col("o_orderkey") % self.num_authors
        return (
            self.table("orders")
            .select(F.col("o_custkey").alias("a"), second.alias("b"))
            .where("a <> b")
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
                        F.struct(F.col("b").alias("src"), F.col("a").alias("dst")),
                    )
                ).alias("e")
            )
            .select("e.*")
            .distinct()
        )

    @cached_property
    def potentially_equates(self) -> DataFrame:
        near = self.authors.withColumn("band", F.floor(F.col("c_acctbal") / 1000))
        return star(near, ["c_nationkey", "c_mktsegment", "band"], "idx").select(
            F.col("first").alias("src"), F.col("idx").alias("dst")
        )

    def _pairs(self, group: str, rows: DataFrame) -> DataFrame:
        """Pairs in groups whose size the construction bounds (3 or 12)."""
        a = rows.select(group, F.col("idx").alias("src"))
        b = rows.select(group, F.col("idx").alias("dst"))
        return a.join(b, group).where("src < dst").select("src", "dst")

    @cached_property
    def equates(self) -> DataFrame:
        return self._pairs("orcid", self.authors.where("orcid <> ''"))

    @cached_property
    def similar(self) -> DataFrame:
        return self._pairs("block", self.authors)

    @cached_property
    def similar_for_dedup(self) -> DataFrame:
        return self.similar.where("(src + dst) % 3 <> 0")

    def cosine_scores(self, edges: DataFrame) -> DataFrame:
        """Cosine scores of the author features, which stand in for a trained scorer."""
        return cosine_scores(edges, self.author_features.select("idx", F.col("feat").alias("vec")))

    def edges(self, etype: str) -> DataFrame:
        if etype == "is_written_by":
            return self.writes.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return getattr(self, etype)

    def raw_edges(self, etype: str) -> DataFrame:
        """The relation as pairs of string ids, with extra edges to unknown ids."""
        prefix = {"author": "a", "publication": "p"}
        kind = EDGE_TYPES[etype]
        links = self.edges(etype)
        src = F.concat(F.lit(prefix[kind.src_type]), F.col("src").cast("string"))
        dst = F.concat(F.lit(prefix[kind.dst_type]), F.col("dst").cast("string"))
        unknown = F.concat(F.lit("x"), F.col("dst").cast("string"))
        # every 50th source gets a second edge that cannot be resolved
        ends = F.when(F.col("src") % 50 == 0, F.array(dst, unknown)).otherwise(F.array(dst))
        return links.select(src.alias("src_id"), F.explode(ends).alias("dst_id"))
