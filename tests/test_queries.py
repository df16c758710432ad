"""Every query of the catalogue against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quire import catalogue

SF = "/root/testdata/sf0.001"


def plain(frame: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return ""
        return str(round(float(x), 5) + 0.0) if isinstance(x, (int, float)) or hasattr(x, "item") and not isinstance(x.item(), (str, bool)) else str(x)

    cols = sorted(frame.columns)
    return sorted(tuple(one(v) for v in row) for row in frame[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(got) or name in {"literal_match", "match_boxes", "widgets_on_imported_pages", "kept_except_removed", "target_size"}
    if sql := catalogue.ORACLES.get(name):
        assert plain(got) == plain(duck.execute(sql).fetchdf())
