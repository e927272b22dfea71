"""Operators on small inputs of every kind, against results worked out by hand."""

import duckdb
import hand_answers
import hand_files
import hand_pages
import hand_records
import pandas as pd
import pytest


@pytest.mark.parametrize("name", sorted(hand_pages.CASES))
def test_by_hand(spark, name):
    got = hand_pages.CASES[name](spark, "").toPandas()
    want = duckdb.sql(hand_pages.WANTED[name]).df()
    one = lambda x: None if pd.isna(x) else round(float(x), 5) if hasattr(x, "real") and not isinstance(x, bool) else str(x)
    rows = lambda df: sorted((tuple(one(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)
    assert len(got) and rows(got) == rows(want)


def test_all_are_here():
    assert len(hand_pages.CASES) >= 27 and hand_records.RAW and hand_files._BODY and hand_answers._ASKED
