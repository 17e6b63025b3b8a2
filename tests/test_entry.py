import importlib.util
import sys

import __spark_entry__ as entry
import pytest
from shoebox.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_entry_has_stable_columns(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["library_id", "event_no"] and not df.isEmpty()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["event_story_summary", "near_dup_groups", "collision_sequence", "constrained_recluster"])
def test_queries_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "customer part orders lineitem events documents embeddings pages labels".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(ORACLES[name]).select(*cols).fetchall()
    plain = lambda rows: sorted(repr(tuple(round(v, 5) if isinstance(v, float) else v for v in r)) for r in rows)
    assert plain(tuple(r[c] for c in cols) for r in df.collect()) == plain(want)


def test_training_queries_are_there_with_their_package():
    there = importlib.util.find_spec("shoebox.llm") is not None
    assert there == any(n.startswith("op1_") for n in entry.queries())


def test_a_missing_library_leaves_the_other_queries(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("shoebox.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
