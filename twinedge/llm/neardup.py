"""Operator 3, MinHash near-dedup with tensored banding.

A table key needs four MinHash values. Instead of four fresh values per table,
``COLLECTIONS`` small collections of two values each are computed, and every
pair of collections is a table: 16 collections (32 values) give 120 tables that
would take 480 values. Two sets of similarity s share a table when they agree
in two collections, each with probability s^2; at s = 0.75 they miss each other
with probability 4e-5.

A collection value that only one set has cannot be part of a shared key, so
values are counted first (16 rows per set) and only shared ones are paired up.

A bucket is not expanded into its pairs. Members are first compared with one
pivot of the bucket and confirmed links are contracted, so a group of near
copies costs a row per member. In buckets that still hold more than one
component, members of different components meet, but only where the sets can be
similar at all. For that, each set has a bit vector of the shingles that other
sets have too (shingles of its own, as edits make them, are left out): what two
sets share is at most the number of bits they share, plus what shares a bit
within the smaller one. The bound is never too small, so no link is lost. A pair
that shares many tables meets in the first of them only: the table of the first
two collections in which both agree. Rows with equal sets are one node from the
start.

Bucket rows are narrow (key, node, table); what is known of a set is joined where
a bucket is still open. Tables are removed once the next ones are written.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinedge.llm.words import map_slices, mixed, shingle_sets, sums, without, words_of
from twinedge.operators.components import linked_nodes, undirected
from twinedge.scratch import discard, materialise

WIDTH = 5
SIMILAR = 75
COLLECTIONS = 16
DEPTH = 2
LONGS = 16
"""Size of the bit vector of a set's shared shingles."""
BITS = [f"b{k}" for k in range(LONGS)]
FILTER_BITS = 23
"""log2 of the bits of the fixed-size filter that spares rebuilding sets nobody asks for."""


def _signatures(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Collection values, a row per non-empty set."""
    filled = starts[:-1][np.diff(starts) > 0]
    out = np.empty((len(filled), COLLECTIONS), np.uint64)
    if not len(filled):
        return out
    for c in range(COLLECTIONS):
        value = np.full(len(filled), c, np.uint64)
        for d in range(DEPTH):
            factor = mixed(np.array([c * DEPTH + d + 1], np.uint64))[0] | np.uint64(1)
            value = mixed(value) ^ np.minimum.reduceat(shingles * factor, filled)
        out[:, c] = mixed(value)
    return out


def _signature_bytes(shingles: np.ndarray, starts: np.ndarray) -> list[bytes | None]:
    """The signature of each set, null for an empty one."""
    found = iter(_signatures(shingles, starts))
    return [next(found).tobytes() if n else None for n in np.diff(starts).tolist()]


def _set_keys(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Both halves of a 128-bit hash of each set; the first names its node."""
    keys = np.zeros((len(starts) - 1, 2), np.int64)
    for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        if b > a:
            keys[k] = np.frombuffer(xxhash.xxh3_128_digest(shingles[a:b].tobytes()), np.int64)
    return keys


def _summaries(rows: DataFrame) -> DataFrame:
    """``(doc_id, n, k1, k2, sig)``: set size, 128-bit hash of the set, signature."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        shingles, starts = shingle_sets(words_of(batch.column("text")), WIDTH)
        n = np.diff(starts)
        full = n > 0
        keys = _set_keys(shingles, starts)
        sig = _signature_bytes(shingles, starts)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n), pa.array(keys[:, 0], mask=~full), pa.array(keys[:, 1], mask=~full), pa.array(sig, pa.binary())],
            names=["doc_id", "n", "k1", "k2", "sig"],
        )

    return map_slices(rows, work, "doc_id long, n long, k1 long, k2 long, sig binary")


def _collection_rows(nodes: DataFrame) -> DataFrame:
    """``(node, c, value)`` for every collection of every node."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.int64)
        node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), COLLECTIONS)
        c = np.tile(np.arange(COLLECTIONS, dtype=np.int32), batch.num_rows)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(c), pa.array(values)], names=["node", "c", "value"])

    return map_slices(nodes, work, "node long, c int, value long", "sig")


LANES = [f"v{k}" for k in range(COLLECTIONS)]
"""32 bits of each collection value of a node."""


def _lanes(nodes: DataFrame) -> DataFrame:
    """``(node, v0...)``, to tell in which collections two nodes agree. Two that
    differ are taken as equal with probability 2^-32."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.int64).reshape(-1, COLLECTIONS)
        low = np.ascontiguousarray((values & 0xFFFFFFFF).astype(np.uint32).view(np.int32).T)
        return pa.RecordBatch.from_arrays([batch.column("node"), *(pa.array(x) for x in low)], names=["node", *LANES])

    return map_slices(nodes, work, "node long, " + ", ".join(f"{v} int" for v in LANES), "sig")


def _buckets(nodes: DataFrame) -> DataFrame:
    """``(key, node, earlier)`` of all tables, for keys made of values that
    several nodes share; ``earlier`` has a bit for each collection before the
    table's second one, but not its first."""
    rows = _collection_rows(nodes)
    shared = rows.groupBy("c", "value").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("c", "value")
    alive = rows.join(shared, ["c", "value"]).groupBy("node").agg(F.collect_list(F.struct("c", "value")).alias("own")).where(F.size("own") > 1)

    def table(x: Column, y: Column) -> Column:
        bit = lambda c: F.pow(F.lit(2), c)
        earlier = (bit(y["c"]) - 1 - bit(x["c"])).cast("int")
        return F.struct(F.xxhash64(x["c"], x["value"], y["c"], y["value"]).alias("key"), earlier.alias("earlier"))

    pairs = F.flatten(F.transform("own", lambda x: F.transform(F.filter("own", lambda y: y["c"] > x["c"]), lambda y: table(x, y))))
    # at most 120 keys per node, from at most 16 values
    return alive.select("node", F.inline(pairs)).select("key", "node", "earlier")


def _id_filter(nodes: DataFrame) -> np.ndarray:
    """A bit for each hash of a node's document; 1 MB whatever the number of nodes."""
    at = F.pmod(F.xxhash64("rep"), F.lit(1 << FILTER_BITS))
    bits = (
        nodes.select((at + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    )
    out = np.zeros(1 << FILTER_BITS, bool)
    for row in bits:
        first = (row["part"] - 1) * (1 << 15)
        out[first : first + (1 << 15)] = np.unpackbits(np.frombuffer(bytes(row["bits"]), np.uint8), bitorder="little")
    return out


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, shingles)`` for the wanted ``(node, rep)``, from the texts of
    the documents ``rep`` again."""
    asked = rows.sparkSession.sparkContext.broadcast(np.packbits(_id_filter(wanted)))
    place = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << FILTER_BITS))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        at = batch.column("place").to_numpy(zero_copy_only=False)
        near = np.flatnonzero((asked.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
        if not len(near):
            return None
        batch = batch.take(pa.array(near))
        shingles, starts = shingle_sets(words_of(batch.column("text")), WIDTH)
        packed = [shingles[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        node = pa.array(_set_keys(shingles, starts)[:, 0])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), node, pa.array(packed, pa.binary())], names=["rep", "node", "shingles"])

    found = map_slices(rows.select("doc_id", place.alias("place"), "text"), work, "rep long, node long, shingles binary")
    return found.join(wanted, ["node", "rep"], "left_semi").select("node", "shingles").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` whose full sets are similar enough."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for k, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            if 100 * min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
                continue
            both = np.concatenate([a, b])
            both.sort()
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            if 100 * shared >= SIMILAR * (len(both) - shared):
                keep.append(k)
        return batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    with_a = pairs.select("u", "v").join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    with_b = with_a.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    return map_slices(with_b.select("u", "v", "a", "b"), work, "u long, v long", "a")


def _shared_sizes(sets: DataFrame) -> DataFrame:
    """``(node, n, shared, doubled, b0...)``: size of each set, how many of its
    shingles may be in another set too, a bit vector of these, and how many of
    them have no bit of their own.

    Shingles are hashed to a bit vector of 8 bits per shingle, at most 8 MB;
    where two meet by chance ``shared`` is too large, which only costs time.
    """
    total = (sets.agg(F.sum(F.length("shingles"))).first()[0] or 0) // 8
    bits = min(26, max(16, (8 * total).bit_length()))
    fan = min(bits - 10, max(0, (total >> 20).bit_length()))
    shift, part_shift = np.uint64(64 - bits), np.uint32(bits - fan)

    def places(batch: pa.RecordBatch) -> np.ndarray:
        return (mixed(np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.uint64)) >> shift).astype(np.uint32)

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = np.sort(places(batch))
        edge = np.searchsorted(at >> part_shift, np.arange((1 << fan) + 1))
        blobs = [at[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(1 << fan, dtype=np.int32)), pa.array(blobs, pa.binary())], names=["part", "at"])

    def twice(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(np.frombuffer(b"".join(rows["at"]), np.uint32))
        seen = np.zeros(1 << int(part_shift), bool)
        seen[at[1:][at[1:] == at[:-1]] & np.uint32((1 << int(part_shift)) - 1)] = True
        return pd.DataFrame({"part": [key[0]], "seen": [np.packbits(seen).tobytes()]})

    parts = map_slices(sets.select("shingles"), spread, "part int, at binary", "shingles").groupBy("part").applyInPandas(twice, "part int, seen binary")
    vector = np.zeros((1 << bits) // 8, np.uint8)
    for row in parts.toLocalIterator():
        size = (1 << int(part_shift)) // 8
        vector[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["seen"], np.uint8)
    shipped = sets.sparkSession.sparkContext.broadcast(vector)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = places(batch)
        hit = (shipped.value[at >> np.uint32(3)] >> (np.uint32(7) - (at & np.uint32(7))).astype(np.uint8)) & 1
        n = np.array([len(x) // 8 for x in batch.column("shingles").to_pylist()], np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        hit = hit.astype(bool)
        bits = np.zeros((len(n), 64 * LONGS), bool)
        values = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.uint64)[hit]
        bits[np.repeat(np.arange(len(n)), n)[hit], (values % np.uint64(64 * LONGS)).astype(np.int64)] = True
        shared = sums(hit.astype(np.int64), ends)
        packed = np.packbits(bits, axis=1).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(n), pa.array(shared), pa.array(shared - bits.sum(axis=1)), *(pa.array(x) for x in packed.T.copy())],
            names=["node", "n", "shared", "doubled", *BITS],
        )

    return map_slices(sets, count, "node long, n long, shared long, doubled long, " + ", ".join(f"{b} long" for b in BITS), "shingles")


def _possible() -> Column:
    """Whether two members can be similar: what they share is bounded, and must
    be SIMILAR / (100 + SIMILAR) of both sizes."""
    common = sum((F.bit_count(F.col(b).bitwiseAND(F.col(f"{b}_2"))) for b in BITS[1:]), F.bit_count(F.col(BITS[0]).bitwiseAND(F.col(f"{BITS[0]}_2"))))
    bound = F.least("shared", "shared_2", common + F.least("doubled", "doubled_2"))
    return (100 + SIMILAR) * bound >= SIMILAR * (F.col("n") + F.col("n_2"))


def _open(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members ``(key, node, earlier, comp, least)`` of buckets of several
    components; ``least`` is the smallest hash of a member."""
    placed = members.join(comp, "node")
    state = placed.groupBy("key").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.xxhash64("node")).alias("least")
    ).where("low < high")
    # one row per key on the right, so a large bucket can be split
    return placed.join(state.select("key", "least"), "key")


def _others(known: DataFrame, but: str) -> DataFrame:
    return known.select(*[F.col(c) if c == but else F.col(c).alias(f"{c}_2") for c in known.columns])


def _with_pivot(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of a member and the pivot of a bucket that can be similar."""
    pivots = rows.where(F.xxhash64("node") == F.col("least")).select("key", F.col("node").alias("node_2"), F.col("comp").alias("comp_2"))
    met = rows.join(pivots, "key").where("comp <> comp_2").select("node", "node_2").distinct()
    sized = met.join(known, "node").join(_others(known, "").withColumnRenamed("node_2", "other"), F.col("node_2") == F.col("other"))
    return sized.where(_possible()).select(F.least("node", "node_2").alias("u"), F.greatest("node", "node_2").alias("v")).distinct()


def _among(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of members of different components that can be similar,
    each from the first table that it shares."""
    full = rows.select("key", "node", "earlier", "comp").join(known, "node")
    agree = sum(
        (F.when(F.col(v) == F.col(f"{v}_2"), F.lit(1 << k)).otherwise(F.lit(0)) for k, v in enumerate(LANES[1:], 1)),
        F.when(F.col(LANES[0]) == F.col(f"{LANES[0]}_2"), F.lit(1)).otherwise(F.lit(0)),
    )
    first = agree.bitwiseAND(F.col("earlier")) == 0
    met = full.join(_others(full.drop("earlier"), "key"), "key").where(
        (F.col("node") < F.col("node_2")) & (F.col("comp") != F.col("comp_2")) & first & _possible()
    )
    return met.select(F.col("node").alias("u"), F.col("node_2").alias("v")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row for each input row.

    Texts without words (null and empty ones too) have an empty set and are
    linked with nothing. Rows that repeat a doc_id are one document: their
    texts' sets are linked. A null doc_id is linked with nothing, its component
    is null and it is kept. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    summary = materialise(_summaries(rows), "minhash-summary")
    solid = summary.where("n > 0 AND doc_id IS NOT NULL")
    # a node is a set, named by the first half of its hash; ``rep`` is its smallest doc_id
    first = materialise(solid.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "distinct-sets")
    member = solid.join(first, ["k1", "k2"])
    # equal sets under two ids, or one id with two sets: both are links already
    known = member.where("doc_id <> rep").select(F.col("rep").alias("u"), F.col("doc_id").alias("v")).distinct()

    at_node = materialise(member.where("doc_id = rep").select(F.col("k1").alias("node"), "sig").dropDuplicates(["node"]), "set-signatures")
    every_bucket = materialise(_buckets(at_node), "minhash-buckets")
    crowded = every_bucket.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("key")
    buckets = materialise(every_bucket.join(crowded, "key"), "crowded-buckets")
    discard(every_bucket)
    reps = first.select(F.col("k1").alias("node"), "rep")
    wanted = materialise(buckets.select("node").distinct().join(reps, "node"), "wanted-sets")
    sets = materialise(_sets(rows, wanted), "shingle-sets")

    # what is known of each set that can be similar to another
    sizes = _shared_sizes(sets).where(100 * F.col("shared") >= SIMILAR * F.col("n"))
    known_sets = materialise(sizes.join(_lanes(at_node), "node"), "set-vectors")
    members = materialise(buckets.join(known_sets.select("node"), "node"), "bucket-members")
    discard(buckets, at_node)
    comp = wanted.select("node", F.col("node").alias("comp"))
    # every member against the pivot of its bucket
    star = materialise(_with_pivot(_open(members, comp), known_sets), "pivot-pairs")
    links = materialise(_confirmed(star, sets), "pivot-links")
    comp = _components(wanted, links)
    # members that this left in different components
    rest = materialise(_among(_open(members, comp), known_sets).join(star, ["u", "v"], "left_anti"), "open-pairs")
    discard(members, known_sets, star, comp)
    links = materialise(links.unionByName(_confirmed(rest, sets)), "set-links")
    discard(sets, rest)

    # from sets to documents: all sets of one doc_id meet in it
    for end in ("u", "v"):
        links = links.join(wanted.select(F.col("node").alias(end), F.col("rep").alias(f"doc_{end}")), end)
    every = known.unionByName(links.where("doc_u <> doc_v").select(F.col("doc_u").alias("u"), F.col("doc_v").alias("v")))
    grouped = linked_nodes(undirected(every.select(F.col("u").alias("src"), F.col("v").alias("dst"))))
    placed = grouped.select(F.col("idx").alias("doc_id"), F.col("component"))
    return (
        summary.select("doc_id", F.col("n").alias("n_shingles"))
        .join(placed, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    solved = linked_nodes(undirected(links.select(F.col("u").alias("src"), F.col("v").alias("dst"))))
    placed = nodes.join(solved.select(F.col("idx").alias("node"), "component"), "node", "left")
    return materialise(placed.select("node", F.coalesce("component", "node").alias("comp")), "set-components")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; rows
    and columns as they are.

    Null, empty and blank texts are in no group and stay, as does a null doc_id;
    rows that repeat a doc_id stay or go together.
    """
    gone = near_duplicates(docs).where("NOT kept").select("doc_id")
    return without(docs, gone)
