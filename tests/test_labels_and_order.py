"""Positions, balancing, splits and negatives against plain Python."""

import hashlib
import random
from collections import Counter

import pytest
from helpers import rows

from twinedge.operators import labels, ordering


@pytest.fixture(params=["true", "false"])
def coalesced(spark, request):
    """Ranges joined by AQE, or one per shuffle partition."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield request.param
    spark.conf.set(key, before)


def test_running_total_over_many_partitions(spark, coalesced):
    draw = random.Random(0)
    data = [(draw.randrange(10**6), draw.randrange(5)) for _ in range(2000)]
    data = list({k: v for k, v in data}.items())
    df = spark.createDataFrame(data, "k bigint, n bigint").repartition(7)
    total, expected = 0, []
    for k, n in sorted(data):
        expected.append((k, n, total))
        total += n
    assert rows(ordering.running_total(df, ["k"], "n")) == expected


def test_running_total_of_nothing(spark):
    assert rows(ordering.running_total(spark.createDataFrame([], "k bigint, n bigint"), ["k"], "n")) == []


def test_dense_index_puts_null_first(spark):
    df = spark.createDataFrame([("b",), (None,), ("",), ("b",)], "orcid string")
    found = {r["orcid"]: r["label"] for r in ordering.dense_index(df, "orcid").collect()}
    assert found == {None: 0, "": 1, "b": 2}


def test_orcid_labels_tell_empty_from_null(spark):
    df = spark.createDataFrame([(0, "x"), (1, None), (2, ""), (3, None), (4, "x")], "idx bigint, orcid string")
    found = dict(rows(labels.orcid_labels(df)))
    assert found == {0: 2, 1: 0, 2: 1, 3: 0, 4: 2}
    with pytest.raises(ValueError):
        labels.require_label_per_node(labels.orcid_labels(df), 6)


def by_hand(bag, train=0.6, valid=0.2):
    """Row-level balancing and splitting, one list per class."""
    m = min(Counter(label for *_, label in bag).get(k, 0) for k in (0, 1))
    out = Counter()
    for label in (0, 1):
        mine = [(s, d) for s, d, k in bag if k == label]
        mine.sort(key=lambda e: (hashlib.md5(f"{e[0]}|{e[1]}".encode()).hexdigest(), e))
        for r, (s, d) in enumerate(mine[:m]):
            part = "train" if r < int(train * m) else "valid" if r < int((train + valid) * m) else "test"
            out[part, label, s, d] += 1
    return out


@pytest.mark.parametrize("copies", [1, 50])
def test_splits_with_copies(spark, copies, coalesced):
    draw = random.Random(copies)
    bag = [(i, i + 1, int(draw.random() < 0.3)) for i in range(60)]
    bag += [bag[0]] * copies + [bag[5]] * copies  # a group of copies in some class
    df = spark.createDataFrame(bag, "src bigint, dst bigint, label int")
    found = {tuple(r)[:4]: r["copies"] for r in labels.edge_splits(df).collect()}
    expected = by_hand(bag)
    assert found == expected
    whole = Counter()
    for (_, label, s, d), n in expected.items():
        whole[label, s, d] += n
    assert {tuple(r)[:3]: r["copies"] for r in labels.balanced_edges(df).collect()} == whole
    assert labels.expand_copies(labels.edge_splits(df), chunk=7).count() == sum(expected.values())


def test_splits_of_one_class_are_empty(spark):
    df = spark.createDataFrame([(0, 1, 1), (1, 2, 1)], "src bigint, dst bigint, label int")
    assert labels.edge_splits(df).count() == 0


def test_negatives(spark):
    edges = spark.range(200).selectExpr("id AS src", "id + 1 AS dst")
    drawn = labels.negative_edges(edges, 4, 10**12)
    again = labels.negative_edges(edges.repartition(3), 4, 10**12)
    assert rows(drawn) == rows(again)
    ends = [r["neg_dst"] for r in drawn.collect()]
    assert len(ends) == 800 and 0 <= min(ends) and max(ends) < 10**12
    assert max(ends) > 2**33  # all nodes can be reached, not only 32 bits of them


def test_order_does_not_touch_the_data(spark):
    from twinedge.operators.ordering import dense_index, positional_index

    big = 2**53 + 1
    df = spark.createDataFrame([(1.0, big), (float("nan"), None), (2.0, big + 2)], "x double, big bigint")
    found = {r["position"]: (str(r["x"]), r["big"]) for r in positional_index(df, ["x"]).collect()}
    assert found == {0: ("1.0", big), 1: ("2.0", big + 2), 2: ("nan", None)}
    values = spark.createDataFrame([(big,), (None,), (big + 1,), (big,)], "v bigint")
    assert {r["v"]: r["label"] for r in dense_index(values, "v").collect()} == {None: 0, big: 1, big + 1: 2}
    assert positional_index(df.where("false"), ["x"]).count() == 0


def test_split_leakage(spark):
    from twinedge.operators.labels import split_leakage

    rows_ = [("train", 1, 0, 1, 2), ("valid", 1, 1, 0, 3), ("train", 0, 2, 3, 1), ("test", 0, 4, 5, 1), ("test", 0, 5, 4, 1)]
    splits = spark.createDataFrame(rows_, "split string, label int, src bigint, dst bigint, copies bigint")
    assert [tuple(r) for r in split_leakage(splits).collect()] == [(0, 1, "train", "valid", 5)]
