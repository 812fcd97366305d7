"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from kinweave.plans import catalogue

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    return con


def rounded(rows):
    return sorted(repr(tuple(round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else int(x) if isinstance(x, bool) else x for x in r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    ran = duck.execute(catalogue.ORACLE_SQL[name])
    have = [x[0] for x in ran.description]
    assert sorted(have) == columns
    want = [tuple(r[have.index(c)] for c in columns) for r in ran.fetchall()]
    assert rounded(got) == rounded(want)


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", ["indel_ratio", "token_set_ratio", "token_sort_ratio", "partial_ratio"])
def test_ratios_equal_their_functions(spark, name):
    """Ratios have no SQL: every pair of the query against the function, and each pair there once."""
    from kinweave.functions import similarity
    from kinweave.plans import worlds

    one = getattr(similarity, {"indel_ratio": "ratio"}.get(name, name))
    addr = {r["id"]: r["addr"] for r in worlds.records(spark, D).select("id", "addr").collect()}
    want = {(r["s1"], r["r"]): round(one(addr[r["s1"]], addr[r["r"]]), 6) for r in worlds.true_pairs(worlds.records(spark, D)).collect()}
    rows = catalogue.QUERIES[name](spark, D).collect()
    assert len(rows) == len(want) > 50
    assert {(r["s1"], r["r"]): round(r["ratio"], 6) for r in rows} == want


def test_worlds_have_what_they_are_for(spark):
    """No list of aliases, misses or orphans is empty on both sides."""
    sf = "/root/testdata/sf0.01"
    for name in ("region_alias", "missed_pairs", "orphans"):
        assert catalogue.QUERIES[name](spark, sf).count() > 10


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=top, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr


def test_scorer_query_is_whole(spark, monkeypatch):
    """The registered query asks for the scorer's own rounds, depth and folds, and for every feature of its edges."""
    from kinweave.operators import scorer

    asked = {}

    def two_stage(train, evaluate, features, k=4, params=None):
        asked.update(features=features, k=k, params=params or scorer.Params(), folds=train.select("fold").distinct().count())
        return evaluate.withColumn("p", evaluate["cos"])

    monkeypatch.setattr(scorer, "two_stage", two_stage)
    assert catalogue.QUERIES["stage_scorer"](spark, D).count() > 0
    assert (asked["params"], asked["k"], asked["folds"]) == (scorer.Params(), 4, 4)
    assert (asked["params"].rounds, asked["params"].depth, asked["params"].least) == (300, 7, 100)
    assert len(asked["features"]) == 7


def test_records_are_normalised_by_many_tasks(spark):
    """A table of one small file is read by one task; what follows is not left to it."""
    from kinweave.plans import worlds

    plan = worlds.records(spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan


def test_roster_reads_the_edges_once(spark, tmp_path):
    from kinweave.operators import evaluation

    edges = [("c", "a", "x"), ("c", "a", "y"), ("c", "b", "x"), ("e", "d", "z")]
    truth = [("c", "a", "x"), ("c", "a", "w"), ("c", "b", "y"), ("e", "f", "z")]
    spark.createDataFrame(edges, "country string, s1 string, r string").write.parquet(f"{tmp_path}/many_edges")
    s1 = spark.createDataFrame([("c", "a"), ("c", "b"), ("e", "d"), ("e", "f"), ("e", "g")], "country string, id string")
    held = spark.read.parquet(f"{tmp_path}/many_edges")
    for e, t in ((held, spark.createDataFrame(truth, "country string, s1 string, r string")), (held.drop("country"), spark.createDataFrame([x[1:] for x in truth], "s1 string, r string"))):
        out = evaluation.roster(s1, e, t)
        assert out._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
        got = {r["s1"]: (r["country"], r["n_cand"], r["n_truth"], r["n_truth_in_cands"], r["singleton"], r["zero_cand"]) for r in out.collect()}
        assert got == {"a": ("c", 2, 2, 1, False, False), "b": ("c", 1, 1, 0, False, False), "d": ("e", 1, 0, 0, True, False), "f": ("e", 0, 1, 0, False, True), "g": ("e", 0, 0, 0, True, True)}
