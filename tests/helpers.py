"""Helpers shared by the test modules."""


def rows(df):
    return sorted(tuple(r) for r in df.collect())
