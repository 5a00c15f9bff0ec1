"""Queries against their SQL, on the small tables and on odd rows."""

import os

import duckdb
import pytest

from streamlearn.llm import oracles
from streamlearn.llm import queries as Q


@pytest.mark.parametrize("where", ["sf", "odd", "labelled"])
@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_equals_sql(spark, sf_dir, small_dir, labelled_dir, name, where):
    d = {"sf": sf_dir, "odd": small_dir, "labelled": labelled_dir}[where]
    con = duckdb.connect()
    for t in ("documents", "labels"):
        path = f"{d}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = Q.queries()[name](spark, d)
    found = con.execute(oracles.SQL[name])
    columns = [c[0] for c in found.description]
    key = lambda rows, names: sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in rows), key=str)
    assert sorted(columns) == sorted(df.columns)
    assert key([tuple(r) for r in df.collect()], df.columns) == key(found.fetchall(), columns)


def test_cutoffs_reject_beyond_the_base_rules(spark, labelled_dir):
    """The table on which the SQL agrees is one where the certified cutoffs act."""
    out = Q.op4_quality_rules(spark, labelled_dir).where("not base_failed and not kept").collect()
    assert {r.doc_id // 1000 for r in out} == {5} and len(out) == 400


def test_queries_are_named_for_their_operators():
    assert [n.split("_")[0] for n in Q.queries()] == [f"op{k}" for k in range(1, 11)]
    assert set(Q.oracle_sql()) <= set(Q.queries())
