"""Every query with an oracle gives the oracle's rows; the others run."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as entry
from caseworks.operators import models
from caseworks.plans import model_queries
from caseworks.plans.model_queries import Job, model_jobs
from caseworks.sources.working import kept

DATA = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
OWN = [n for n in entry.queries() if not n.startswith(("op", "pipeline"))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(table, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(r[k] for k in order) for r in table), key=str)


@pytest.mark.parametrize("name", [n for n in OWN if n in ORACLES])
def test_equals_oracle(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    found = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    ours, theirs = rows(map(tuple, df.collect()), df.columns), rows(found.fetchall(), found.columns)
    assert len(ours) == len(theirs)
    assert [[float(v) if isinstance(v, float) else v for v in r] for r in ours] == [[float(v) if isinstance(v, float) else v for v in r] for r in theirs]


@pytest.mark.parametrize("name", [n for n in OWN if n not in ORACLES and n not in model_jobs(Job())])
def test_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("name", ["d01_inner_join", "j30_prepared_cases"])
def test_details_are_not_broadcast(spark, name):
    """Details are as many as the cases; only the policy table, a row for each state, may be built in the driver."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == (name != "d01_inner_join")


def test_labelled_cases_are_dealt_once_in_many_places(spark, monkeypatch):
    """Fits read folds from a table that was written once; places are those of one sort, made range by range."""
    made = []
    monkeypatch.setattr(model_queries, "kept", lambda spark, label, source, make: (made.append(make()), kept(spark, label, source, make))[1])
    parts = [model_queries.labelled(spark, DATA, k=k) for k in (4, 5)]
    assert all(df.inputFiles() and "labelled" in df.inputFiles()[0] and "Window" not in df._jdf.queryExecution().sparkPlan().toString() for df in parts)
    assert "hashpartitioning(error" in made[0]._jdf.queryExecution().executedPlan().toString() and "_range" in made[0]._jdf.queryExecution().sparkPlan().toString()
    rows = [("a", i) for i in range(5000)] + [(None, i) for i in range(300)]
    found = models.dealt(spark.createDataFrame(rows, "s string, case_id long"), "s", 3).collect()
    for stratum in ("a", None):
        order = sorted((hashlib.md5(f"3:{r['case_id']}".encode()).hexdigest(), r["case_id"], r["place"]) for r in found if r["s"] == stratum)
        assert [place for *_, place in order] == list(range(len(order)))
