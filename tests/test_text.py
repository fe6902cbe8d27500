"""Text helpers against the same definitions in Python."""

import hashlib

import pytest
from helpers import rows

from twinedge.functions import text

NAMES = [
    ("Jürgen", "Müller"), ("Øystein", "Ærø"), ("", "Empty"), (None, "Null"), ("Ana", None), ("ßeta", ""),
    ("Łuk", "  Strauß\t"), ("X", "O'Neil"), ("ĳs", "Þór\x0b"), ("é", "İnan"),
]
KEYS = ["mullerj", "aeroo", "", "", "", "ss", "strauss\tl", "o'neilx", "thor\x0bij", "inane"]


def test_lnfi(spark):
    df = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(NAMES)], "i int, name string, surname string")
    found = rows(df.select("i", text.lnfi_key("name", "surname")))
    assert [k for _, k in found] == KEYS


def test_wellformed_lets_null_pass(spark):
    df = spark.createDataFrame(NAMES, "name string, surname string")
    assert df.where(text.is_wellformed("name", "surname")).count() == len(NAMES) - 2


def test_author_id_hashes_the_publication_first(spark):
    df = spark.createDataFrame([("Zoë", "p1")], "fullname string, pub string")
    expected = "00|author______::" + hashlib.md5("p1".encode() + "Zoë".encode()).hexdigest()
    assert df.select(text.author_id("fullname", "pub")).first()[0] == expected


@pytest.mark.parametrize("pos", [-6, -5, -1, 0, 2, 4, 5])
@pytest.mark.parametrize("by", ["", "x", "long"])
def test_replace_char(spark, pos, by):
    word = "añcdé"
    try:
        letters = list(word)
        letters[pos] = by
        expected = "".join(letters)
    except IndexError:
        expected = None
    df = spark.createDataFrame([(word,)], "t string")
    assert df.select(text.replace_char("t", pos, by)).first()[0] == expected


def test_display(spark):
    df = spark.createDataFrame([("A, B", "0000"), ("C", None)], "fullname string, orcid string")
    assert [r[0] for r in df.select(text.author_display("fullname", "orcid")).collect()] == ["A, B (ORCID: 0000)", None]
