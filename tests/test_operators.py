import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseworks.functions import semantics as S
from caseworks.operators import features as X, logits, models as M, rules as K, trees as T
from caseworks.plans import model_queries as Q, rule_queries as R
from caseworks.plans.registry import QUERIES
from caseworks.sources import case_view as V

DATA = "/root/testdata/sf0.001"


def one(spark, col, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(col.alias("x")).first()["x"]


def test_null_semantics(spark):
    assert one(spark, S.at_least(F.col("a"), 0), a=("double", None)) is None
    assert one(spark, S.at_most(F.col("a"), 1), a=("double", 3.0)) == 1.0
    assert one(spark, S.in_set(F.col("a"), ["x"]), a=("string", None)) is False
    assert one(spark, S.ratio(F.col("a"), F.col("b")), a=("double", 1.0), b=("double", 0.0)) is None
    assert one(spark, S.truncated(F.col("a")), a=("double", -1.9)) == -1
    assert one(spark, S.truncated(F.col("a")), a=("double", 1e20)) is None
    assert one(spark, S.lowest([F.col("a")]), a=("int", None)) == math.inf
    assert one(spark, X.labour_force(["a", "b"]), a=("int", None), b=("int", None)) == "all working age"
    assert S.steps(0, 1, 0.1)[3] == 0.30000000000000004 and S.steps(0, 1, 0.1)[-1] == 1.0


def test_strata_trim_and_case(spark):
    row = spark.createDataFrame([(" OverIssuance\t", True, False)], "status string, has_earned_inc_error boolean, has_unearned_inc_error boolean")
    assert X.error_strata(row).first()["error_status"] == "earned_overissuance"


def test_round_trip_of_recovery(spark):
    """Where nothing was in error, the verified benefit is the observed one, but for its rounding."""
    df = X.recover_income(V.cases(spark, DATA)).filter("status = 'amount correct'")
    assert df.filter("benefit_gap >= 1").count() == 0


def test_missing_feature():
    class Table:
        columns = ["a"]

    with pytest.raises(ValueError, match="b"):
        X.require(Table(), ["a", "b"])


AXES = [K.Axis("a", ">=", (0.0, 0.30000000000000004, 0.6)), K.Axis("b", "band", lower=(0.0, 0.5), upper=(0.5, 1.0)), K.Axis("c", "<", (1.0, 2.0))]


def test_cells_equal_naive(spark):
    rows = [(f"g{i % 2}", (i % 7) / 10 if i % 11 else None, (i % 5) / 4, float(i % 3), ["overissuance", "amount correct", "underissuance"][i % 3], float(i % 90), 1.0 + i % 4 / 100) for i in range(200)]
    df = spark.createDataFrame(rows, "state string, a double, b double, c double, status string, amterr double, fywgt double")
    found = {(r["geography_value"], r["a_bound"], r["b_lower"], r["b_upper"], r["c_bound"]): (r["n_flagged"], round(r["error_dollars_captured"], 6)) for r in K.mine_rules(df, AXES, min_dollars=0).collect()}
    naive = {}
    for state, a, b, c, status, amount, w in rows:
        if status == "underissuance" or a is None:
            continue
        for t1 in AXES[0].bounds:
            for lo in (0.0, 0.5):
                for hi in (0.5, 1.0):
                    for t3 in (1.0, 2.0):
                        if lo <= hi and a >= t1 and lo <= b < hi and c < t3:
                            n, d = naive.get(key := (state, t1, lo, hi, t3), (0, 0.0))
                            naive[key] = n + 1, d + (amount * w if status == "overissuance" else 0.0)
    assert found == {k: (n, round(d, 6)) for k, (n, d) in naive.items()}


def test_surface_cells_add_up(spark):
    rows = [("s", None if i % 5 == 0 else float(i % 9), (i % 4) / 4, float(i % 3), i % 7 == 0) for i in range(100)]
    df = spark.createDataFrame(rows, "state string, a double, b double, c double, pos boolean")
    axes = [K.Axis("a", ">=", (1.0, 4.0)), K.Axis("c", "<", (1.0, 3.0))]
    for r in K.pr_surface(df, axes, "state", F.col("pos")).collect():
        cells = {True: [0, 0], False: [0, 0]}
        for _, a, _, c, pos in rows:
            parts = [None if a is None else a >= r["a_bound"], c < r["c_bound"]]
            hit = False if False in parts else None if None in parts else True
            if hit is not None:
                cells[hit][pos] += 1
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (cells[True][1], cells[True][0], cells[False][1], cells[False][0])


def test_unknown_value_never_meets_a_rule(spark):
    df = spark.createDataFrame([(1.0, None), (5.0, 2.0)], "a double, b double")
    rule = F.array(F.struct(F.lit("a").alias("column"), F.lit(">=").alias("op"), F.lit(1.0).alias("bound")), F.struct(F.lit("b").alias("column"), F.lit("<").alias("op"), F.lit(3.0).alias("bound")))
    assert [r[0] for r in df.select(K.meets(rule, ["a", "b"])).collect()] == [False, True]


def test_tree_leaves_partition_cases(spark):
    df = V.cases(spark, DATA).filter("status IS NOT NULL").withColumn("flat", F.lit(1.0)).withColumn("none", F.lit(None).cast("double"))
    forest = T.grow(df, "amterr", ["fsearn", "flat", "none", "fssltexp"], "regioncd", T.Limits(max_depth=3))
    assert forest.rows.count() == df.count() == forest.rows.select("case_id").distinct().count()
    leaf = {(r["group"], r["node"]): r["n"] for r in forest.nodes.filter("is_leaf").collect()}
    assert leaf == {(r["group"], r["node"]): r["count"] for r in forest.rows.groupBy("group", "node").count().collect()}
    assert {r["feature"] for r in forest.nodes.collect()} <= {"fsearn", "fssltexp", None}
    assert min(leaf.values()) >= 7


def test_single_leaf_tree_pads(spark):
    df = spark.createDataFrame([(i, 1.0, "g", float(i)) for i in range(30)], "case_id long, y double, g string, x double")
    forest = T.grow(df, "y", ["x"], "g")
    table = T.split_table(forest, 3).collect()
    assert len(table) == 3 and all(r["variable"] is None for r in table)
    assert "mean 1.00" in T.to_dot(forest.nodes.collect(), "g")


def test_planted_split_is_found(spark):
    df = spark.createDataFrame([(i, 100.0 if i % 50 >= 20 else 0.0, "g", float(i % 50), float(i % 3)) for i in range(400)], "case_id long, y double, g string, x double, noise double")
    root = T.grow(df, "y", ["noise", "x"], "g").nodes.filter("node = 1").first()
    assert (root["feature"], root["threshold"]) == ("x", 19.5)


def brute_rules(axes, values):
    """For each rule that flags a row (nulls are NaN): its bounds and the rows it flags."""
    found = {}
    sides = [[(lo, hi) for lo in a.lower for hi in a.upper if lo <= hi] if a.op == "band" else [(b,) for b in a.bounds] for a in axes]
    compare = {">=": np.greater_equal, "<=": np.less_equal, "<": np.less}
    hits = [[(v >= b[0]) & (v < b[1]) if a.op == "band" else compare[a.op](v, b[0]) for b in s] for a, s, v in zip(axes, sides, values, strict=True)]
    for rule in itertools.product(*(range(len(s)) for s in sides)):
        hit = np.logical_and.reduce([h[k] for h, k in zip(hits, rule, strict=True)])
        if hit.any():
            found[tuple(x for s, k in zip(sides, rule, strict=True) for x in s[k])] = hit
    return math.prod(map(len, sides)), found


def test_whole_surface_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = [("s", None if k % 9 == 0 else float(rnd.choice(range(100, 1500, 25))), rnd.choice([0.1, 0.35, 0.7, 0.95, 1.0]), rnd.choice([0.0, 0.05, 0.62, 1.5, 3.97]), rnd.random() < 0.4) for k in range(12)]
    df = spark.createDataFrame(rows, "state string, fsearn double, rawben_rel double, shelter_ratio double, pos boolean")
    table = [np.array([np.nan if r[k] is None else r[k] for r in rows]) for k in (1, 2, 3)]
    size, want = brute_rules(R.SURFACE_RUN, table)
    pos = np.array([r[4] for r in rows])
    assert size == 23 * 19 * 81
    got = {tuple(r[n] for n in K.bounds_of(R.SURFACE_RUN)): (r["tp"], r["fp"]) for r in K.pr_surface(df, R.SURFACE_RUN, "state", F.col("pos")).collect()}
    assert got == {k: (int((h & pos).sum()), int((h & ~pos).sum())) for k, h in want.items()}


@pytest.mark.parametrize("axes, size", [(R.EARNED_DEFAULT, 162_162), (R.UNEARNED_DEFAULT, 509_652), (R.UNDERPAID_DEFAULT, 7_722), (R.EARNED_RUN, 11 * 13 * 21 * 2), (R.UNEARNED_RUN, 11 * 120 * 13), (R.UNDERPAID_RUN, 13 * 153 * 21)])
def test_whole_grids_equal_brute_force(spark, axes, size):
    rnd = random.Random(4)
    marks = [a.marks for a in axes]
    rows = [(["overissuance", "amount correct"][k % 2], 60.0, 1.0, *(rnd.choice(m) + rnd.choice([0.0, 0.01]) for m in marks)) for k in range(4)]
    df = spark.createDataFrame([("s", *r) for r in rows], "state string, status string, amterr double, fywgt double, " + ", ".join(f"{a.column} double" for a in axes))
    whole, want = brute_rules(axes, [np.array([r[3 + k] for r in rows]) for k in range(len(axes))])
    got = {tuple(r[n] for n in K.bounds_of(axes)): r["n_flagged"] for r in K.mine_rules(df, axes, min_dollars=0).collect()}
    assert whole == size and got == {k: int(h.sum()) for k, h in want.items()}


def test_whole_jobs_have_the_size_they_state(spark, monkeypatch):
    seen = []

    def fit(self, rows, params=None):
        seen.append({p.name: v for p, v in self.extractParamMap().items()})
        raise InterruptedError

    for kind in (M.RandomForestRegressor, M.RandomForestClassifier, M.GBTClassifier, M.CrossValidator):
        monkeypatch.setattr(kind, "fit", fit)
    for job in Q.WHOLE.values():
        with pytest.raises(InterruptedError):
            job(spark, DATA)
    assert [s.get("numTrees") for s in seen[:5]] == [500, 500, 1000, 500, 2500]
    assert (seen[5]["maxIter"], seen[5]["maxDepth"], len(seen[6]["estimatorParamMaps"]), seen[6]["numFolds"]) == (1500, 8, 20, 5)


def test_registered_tuning_is_the_whole_grid(spark, monkeypatch):
    """20 penalties over five folds, and the folds are the stratified ones that cases are dealt to."""
    seen = []

    def fit(self, rows, params=None):
        seen.append(({p.name: v for p, v in self.extractParamMap().items()}, rows))
        raise InterruptedError

    monkeypatch.setattr(M.CrossValidator, "fit", fit)
    with pytest.raises(InterruptedError):
        QUERIES["m11_tuning"](spark, DATA)
    (params, rows), = seen
    penalties = [v for point in params["estimatorParamMaps"] for p, v in point.items() if p.name == "regParam"]
    assert penalties == Q.PENALTIES and len(set(penalties)) == 20 and (params["numFolds"], params["foldCol"]) == (5, "fold")
    assert rows.count() == Q.labelled(spark, DATA).count()
    sizes = {(r["label"], r["fold"]): r["count"] for r in rows.groupBy("label", "fold").count().collect()}
    assert {f for _, f in sizes} == set(range(5)) and all(max(n) - min(n) <= 1 for n in ([v for (y, _), v in sizes.items() if y == label] for label in (0, 1)))


def test_shared_passes_equal_one_fit_each(spark):
    """Coefficients are those of Spark's logit on the other folds; areas are exact, ties count half, in one range of scores or many."""
    penalties, k = [0.0, 1e-3, 1.0], 3
    rows = M.vectors(Q.labelled(spark, DATA, k=k), Q.NUMBERS, F.col("error")).select("features", "label", "fold").cache()
    plain = rows.select("fold", "label", *(M.vector_to_array("features")[j].alias(f"x{j}") for j in range(5)))
    models = logits.fold_logits(plain, np.array(penalties), k)
    one, many = logits.fold_areas(plain, models), logits.fold_areas(plain, models, 20)
    assert np.array_equal(one, many)
    table = np.array([tuple(r) for r in plain.collect()], float)
    for f in range(k):
        for m, penalty in enumerate(penalties):
            want = M.LogisticRegression(regParam=penalty, tol=1e-13, maxIter=1000).fit(rows.filter(F.col("fold") != f))
            assert np.allclose(models[f, m], [want.intercept, *want.coefficients.toArray()], rtol=1e-3, atol=1e-8)
            held = table[table[:, 0] == f]
            z = logits._scores(held[:, 2:], models[f, m])
            above = z[held[:, 1] > 0][:, None] - z[held[:, 1] == 0][None, :]
            assert one[f, m] == pytest.approx(((above > 0) + 0.5 * (above == 0)).mean(), abs=1e-12)


def test_shared_passes_on_odd_rows(spark):
    """A number that never varies or not in training, labels that a number tells apart, many ties."""
    rows = spark.createDataFrame([(k % 2, float(k % 6 > 2), float(k % 6), 7.0, float(k % 2)) for k in range(240)], "fold int, label double, x0 double, x1 double, x2 double")
    models = logits.fold_logits(rows, np.array([0.0, 0.1]), 2)
    assert np.isfinite(models).all() and np.abs(models[:, :, 2:]).max() < 1e-9
    assert (logits.fold_areas(rows, models) == 1).all() and (logits.fold_areas(rows, models, 7) == 1).all()
    assert (logits.fold_areas(rows, np.zeros((2, 1, 4)), 7) == 0.5).all()


SMALL = Q.model_jobs(Q.Job(3, 3, 2, 2, 3, 2, (0.0, 0.1), 2))


@pytest.mark.parametrize("name", sorted(SMALL))
def test_small_model_jobs(spark, name):
    rows = SMALL[name](spark, DATA).collect()
    truth = [r["amterr"] for r in Q.labelled(spark, DATA).select("amterr").collect() if r["amterr"] is not None]
    if "rmse" in rows[0]:
        assert all(0 < r["rmse"] < 1.2 * np.std([float(t) for t in truth]) for r in rows)
    elif name == "m01_forest_importance":
        assert abs(sum(r["importance"] for r in rows) - 1) < 1e-9
    else:
        assert all(0 <= r[k] <= 1 for r in rows for k in ("p", "area_under_pr", "area_under_roc") if k in r)
    if name == "m03_ablation":
        assert [r["left_out"] for r in rows] == ["none", *Q.NUMBERS]
    assert SMALL[name](spark, DATA).count() == len(rows)


def model_table(spark, label):
    rows = M.vectors(Q.labelled(spark, DATA), Q.NUMBERS, label).select("features", "label").collect()
    return np.array([r["features"].toArray() for r in rows]), np.array([r["label"] for r in rows])


def test_linear_probability_equals_least_squares(spark):
    x, y = model_table(spark, F.col("error"))
    want = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
    got = [r["coefficient"] for r in QUERIES["m07_linear_probability"](spark, DATA).collect()]
    assert np.allclose(got, want, rtol=1e-6, atol=1e-10)


def test_logit_is_at_its_optimum(spark):
    """The slope of the penalised likelihood vanishes; the penalty is on coefficients of standardised numbers."""
    rows = M.vectors(Q.labelled(spark, DATA), Q.NUMBERS, F.col("error"))
    x, y = model_table(spark, F.col("error"))
    model = M.multinomial_logit(0.01).setMaxIter(500).setTol(1e-12).fit(rows)
    logits = x @ model.coefficientMatrix.toArray().T + model.interceptVector.toArray()
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    spread = x.std(axis=0, ddof=1)
    slope = (p - np.eye(2)[y.astype(int)]).T @ x / len(x) / spread + 0.01 * model.coefficientMatrix.toArray() * spread
    assert np.abs(slope).max() < 1e-5


def plain_tree(rows, features, limits, node=1, depth=0, root=None):
    """Nodes of a tree grown recursively: node -> (n, feature, threshold, left levels)."""
    y = [r["y"] for r in rows]
    mean = sum(y) / len(y)
    root = sum((v - mean) ** 2 for v in y) if root is None else root
    best = None
    for f in features if depth < limits.max_depth else []:
        known = [r for r in rows if r[f] is not None]
        if len(known) < limits.min_split:
            continue
        total = sum(r["y"] for r in known)
        if isinstance(known[0][f], str):
            of = {v: [r["y"] for r in known if r[f] == v] for v in {r[f] for r in known}}
            value = {v: sum(z) / len(z) for v, z in of.items()}
        else:
            value = {r[f]: r[f] for r in known}
        marks = sorted(set(value.values()))
        for a, b in zip(marks, marks[1:]):
            left = [r["y"] for r in known if value[r[f]] <= a]
            nl, nr, sl = len(left), len(known) - len(left), sum(left)
            gain = sl * sl / nl + (total - sl) ** 2 / nr - total * total / len(known)
            if nl >= limits.min_leaf and nr >= limits.min_leaf and gain > 0 and gain >= limits.cp * root and (best is None or gain > best[0] + 1e-9):
                best = gain, f, (a + b) / 2, value, nl >= nr
    if best is None:
        return {node: (len(rows), None, None, None)}
    _, f, threshold, value, nulls = best
    side = [nulls if r[f] is None else value[r[f]] < threshold for r in rows]
    levels = sorted(v for v in value if value[v] < threshold) if any(isinstance(v, str) for v in value) else None
    out = {node: (len(rows), f, threshold, levels)}
    for k, want in enumerate((True, False)):
        out |= plain_tree([r for r, s in zip(rows, side) if s == want], features, limits, 2 * node + k, depth + 1, root)
    return out


def test_trees_equal_a_plain_recursive_grower(spark):
    """Numbers, texts and nulls; every node of two trees, thresholds and the levels that go left."""
    rnd = random.Random(8)
    rows = []
    for k in range(500):
        color, shape = rnd.choice(["red", "blue", "green", "grey", None]), rnd.choice("abcdefgh")
        x = rnd.choice([None, *[v / 4 for v in range(40)]])
        y = round(30 * (color in ("red", "grey")) + 11 * ("ceg".find(shape) >= 0) + (x or 0) * 3 + rnd.random() * 9, 2)
        rows.append({"case_id": k, "g": "one" if k % 3 else "two", "y": y, "x": x, "noise": rnd.random(), "color": color, "shape": shape})
    df = spark.createDataFrame(rows, "case_id long, g string, y double, x double, noise double, color string, shape string")
    features, limits = ["x", "color", "noise", "shape"], T.Limits(max_depth=4)
    found = T.grow(df, "y", features, "g", limits)
    for g in ("one", "two"):
        want = plain_tree([r for r in rows if r["g"] == g], features, limits)
        got = {r["node"]: (r["n"], r["feature"], r["threshold"], r["left_levels"]) for r in found.nodes.filter(F.col("group") == g).collect()}
        assert got.keys() == want.keys()
        for node, (n, feature, threshold, levels) in want.items():
            assert got[node][:2] == (n, feature) and got[node][3] == levels and (threshold is None or got[node][2] == pytest.approx(threshold))
    assert " in " in T.to_dot(found.nodes.filter("group = 'one'").collect(), "one")


def test_rounded_trees_count_their_children(spark):
    df = spark.createDataFrame([(k, float(k % 7 * 10 + k % 3), "g", k * 0.37 % 10) for k in range(300)], "case_id long, y double, g string, x double")
    nodes = {r["node"]: r for r in T.grow(df, "y", ["x"], "g", T.Limits(digits=0)).nodes.collect()}
    assert min(r["n"] for r in nodes.values()) >= 7
    assert all(nodes[2 * k]["n"] + nodes[2 * k + 1]["n"] == r["n"] for k, r in nodes.items() if not r["is_leaf"])
