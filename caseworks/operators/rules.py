"""Threshold rules: conjunctions of one-sided bounds, mined over grids of bounds for all geographies at once.

A case matters to a rule only through the place of its values among the bounds. So cases are first summed into cells (one place per axis),
then each axis in turn is unfolded: a cell counts for every bound that it meets, and cells that coincide are summed again. After the
last axis there is one row for each geography and rule that flags anything; no rule is joined with cases.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from caseworks.functions.semantics import ratio
from caseworks.operators.features import CORRECT, OVER, UNDER
from caseworks.operators.report import first_per_group, top_with_ties


@dataclass(frozen=True)
class Axis:
    """Bounds on one column. op is >=, <= or <; a band has lower bounds (>=) and upper bounds (<), the lower at most the upper."""

    column: str
    op: str
    bounds: tuple[float, ...] = ()
    lower: tuple[float, ...] = ()
    upper: tuple[float, ...] = ()

    @property
    def names(self) -> list[str]:
        return [f"{self.column}_lower", f"{self.column}_upper"] if self.op == "band" else [f"{self.column}_bound"]

    def passes(self, value: Column, *bound: Column) -> Column:
        if self.op == "band":
            return (value >= bound[0]) & (value < bound[1])
        return {">=": value >= bound[0], "<=": value <= bound[0], "<": value < bound[0]}[self.op]

    @property
    def marks(self) -> list[float]:
        return sorted({*map(float, self.lower), *map(float, self.upper)}) if self.op == "band" else sorted(map(float, self.bounds))

    def place(self) -> Column:
        """How many of the sorted bounds the value meets; null for null. For a band: how many it reaches."""
        test = {"<=": lambda b: F.col(self.column) <= b, "<": lambda b: F.col(self.column) < b}.get(self.op, lambda b: F.col(self.column) >= b)
        return F.when(F.col(self.column).isNotNull(), F.size(F.filter(_doubles(self.marks), test)))

    def met(self, place: Column, name: str) -> list[tuple[str, Column, list[float]]]:
        """For each bound column of the axis: its name, the indices (from 1) that a value at the place meets, and the bounds. A null place meets all."""
        marks = self.marks
        if self.op == "band":
            low, high = sorted(map(float, self.lower)), sorted(map(float, self.upper))
            upto = [sum(marks.index(v) < p for v in low) for p in range(len(marks) + 1)]
            since = [sum(marks.index(v) < p for v in high) + 1 for p in range(len(marks) + 1)]
            last = F.coalesce(F.get(_ints(upto), place), F.lit(len(low)))
            first = F.coalesce(F.get(_ints(since), place), F.lit(1))
            return [(self.names[0], _run(F.lit(1), last), low), (self.names[1], _run(first, F.lit(len(high))), high)]
        if self.op == ">=":
            return [(self.names[0], _run(F.lit(1), F.coalesce(place, F.lit(len(marks)))), marks)]
        return [(self.names[0], _run(F.lit(len(marks) + 1) - F.coalesce(place, F.lit(len(marks))), F.lit(len(marks))), marks)]


def _doubles(values: Sequence[float]) -> Column:
    return F.expr("array(" + ", ".join(f"{v!r}D" for v in values) + ")")


def _ints(values: Sequence[int]) -> Column:
    return F.expr("array(" + ", ".join(map(str, values)) + ")")


def _run(first: Column, last: Column) -> Column:
    """first, first + 1, ..., last; empty if last comes before first."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.expr("array()").cast("array<int>"))


def unfold(cells: DataFrame, axes: Sequence[Axis], keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """From cells (keys, a place for each axis, sums) to a row for each key and combination of bounds that some cell meets.

    A cell with a null place meets every bound of that axis.
    """
    for k, axis in enumerate(axes):
        left = [f"_p{j}" for j in range(k + 1, len(axes))]
        done = [n for a in axes[:k] for n in a.names]
        opened = cells
        for name, indices, values in axis.met(F.col(f"_p{k}"), f"_p{k}"):
            opened = opened.withColumn("_i", F.explode(indices)).withColumn(name, F.get(_doubles(values), F.col("_i") - 1)).drop("_i")
        if axis.op == "band":
            opened = opened.filter(F.col(axis.names[0]) <= F.col(axis.names[1]))
        cells = opened.groupBy(*keys, *done, *axis.names, *left).agg(*(F.sum(s).alias(s) for s in sums))
    return cells


DOLLARS = "decimal(18,2)"


def _base(cases: DataFrame, geo: str, axes: Sequence[Axis], amount: str, weight: str, target: str, significant: Column, false_positive: Column) -> DataFrame:
    """Per case: geography, places, and what is summed."""
    money, share = F.col(amount).cast(DOLLARS), F.col(weight).cast("decimal(10,4)")
    hit = F.lower("status") == target
    truth = lambda cond: F.coalesce(cond, F.lit(False)).cast("long")
    return cases.select(
        F.col(geo).alias("geography_value"), *(a.place().alias(f"_p{k}") for k, a in enumerate(axes)),
        F.when(hit, F.coalesce(money * share, F.lit(0).cast("decimal(28,6)"))).otherwise(F.lit(0).cast("decimal(28,6)")).cast("decimal(28,6)").alias("captured"),
        F.coalesce(money, F.lit(0).cast(DOLLARS)).alias("flat"), F.lit(1).cast("long").alias("n"), truth(significant).alias("sig"), truth(F.col(amount) > 0).alias("err"), truth(false_positive).alias("fp"),
    )


SUMS = ["captured", "flat", "n", "sig", "err", "fp"]


def mine_rules(
    cases: DataFrame, axes: Sequence[Axis], geo: str = "state", target: str = OVER, amount: str = "amterr", weight: str = "fywgt",
    threshold: float = 52, over_flag: str | None = None, min_dollars: float = 1000,
) -> DataFrame:
    """Metrics of every rule that flags a case, for each geography with enough weighted dollars in error.

    The population leaves out the other kind of error. A case is a significant error if its amount exceeds the threshold, or, given
    over_flag, if that column is 1; the false positives follow the same choice.
    """
    other = UNDER if target == OVER else OVER
    population = cases.filter(F.col("status").isNotNull() & (F.lower("status") != other))
    if over_flag is None:
        significant, false = F.col(amount) > threshold, F.col(amount) <= threshold
    else:
        significant, false = F.col(over_flag) == 1, (F.col(over_flag) != 1) | (F.col(amount) == 0)
    base = _base(population, geo, axes, amount, weight, target, significant, false)
    totals = base.groupBy("geography_value").agg(F.sum("captured").alias("geography_total_error"), F.sum("n").alias("total_n")).filter(F.col("geography_total_error") >= min_dollars)
    places = [f"_p{k}" for k in range(len(axes))]
    cells = base.dropna(subset=places).groupBy("geography_value", *places).agg(*(F.sum(s).alias(s) for s in SUMS))
    found = unfold(cells, axes, ["geography_value"], SUMS).join(totals, "geography_value")
    d = lambda name: F.col(name).cast("double")
    bounds = [n for a in axes for n in a.names]
    return found.select(
        F.lit(geo).alias("geography_type"), "geography_value", d("geography_total_error").alias("geography_total_error"), *bounds, d("captured").alias("error_dollars_captured"),
        F.col("n").alias("n_flagged"), F.col("sig").alias("n_sig_errors_flagged"), F.col("err").alias("n_errors_flagged"), F.col("fp").alias("n_false_positives"),
        ratio(d("captured"), d("geography_total_error")).alias("dollar_recall"), ratio(d("sig"), d("n")).alias("precision"), ratio(d("err"), d("n")).alias("pct_any_error"),
        ratio(d("fp"), d("n")).alias("fpr_flagged"), ratio(d("flat"), d("n")).alias("dollars_per_case"), ratio(d("n"), d("total_n")).alias("pct_flagged"), "total_n",
    )


def bounds_of(axes: Sequence[Axis]) -> list[str]:
    return [n for a in axes for n in a.names]


def best_rules(grid: DataFrame, axes: Sequence[Axis], by: str = "dollars_per_case", min_precision: float = 0.5, max_flagged: float = 0.3, min_recall: float = 0, n: int = 1) -> DataFrame:
    """The best rules of each geography among those within the limits; ties go to the smaller bounds, the last axis first."""
    fit = grid.filter((F.col("precision") >= min_precision) & (F.col("pct_flagged") <= max_flagged) & (F.col("dollar_recall") >= min_recall))
    order = [F.col(by).desc_nulls_last(), *(F.col(b) for b in reversed(bounds_of(axes)))]
    return first_per_group(fit, ["geography_type", "geography_value"], order, n)


def as_rules(best: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    """Rules that say what they test: conditions is an array of (column, op, bound), beside the metrics they were chosen by."""
    parts = []
    for a in axes:
        ops = [">=", "<"] if a.op == "band" else [a.op]
        parts += [F.struct(F.lit(a.column).alias("column"), F.lit(op).alias("op"), F.col(n).alias("bound")) for op, n in zip(ops, a.names, strict=True)]
    return best.withColumn("conditions", F.array(*parts))


def meets(conditions: Column, columns: Sequence[str]) -> Column:
    """Whether a case meets all of its rule's conditions; an unknown value does not."""
    value = lambda t: reduce(lambda rest, name: F.when(t["column"] == name, F.col(name).cast("double")).otherwise(rest), columns, F.lit(None).cast("double"))

    def one(t: Column) -> Column:
        v = value(t)
        return F.coalesce(F.when(t["op"] == ">=", v >= t["bound"]).when(t["op"] == "<=", v <= t["bound"]).when(t["op"] == "<", v < t["bound"]).otherwise(v > t["bound"]), F.lit(False))

    return F.forall(conditions, one)


def apply_rules(rules: DataFrame, cases: DataFrame, columns: Sequence[str], geo: str = "state", amount: str = "amterr", weight: str = "fywgt", over_flag: str = "over_threshold") -> DataFrame:
    """How each geography's rule does on other cases, beside how it did where it was found. Rules are few: one for each geography."""
    rule = rules.select("geography_type", "geography_value", "conditions", *(F.col(m).alias(f"train_{m}") for m in ("dollar_recall", "precision", "n_flagged", "pct_flagged")))
    joined = cases.join(rule, cases[geo] == rule["geography_value"]).withColumn("_hit", meets(F.col("conditions"), columns))
    money = F.col(amount).cast(DOLLARS) * F.coalesce(F.col(weight), F.lit(1.0)).cast("decimal(10,4)")
    sig, error = F.col(over_flag) == 1, F.lower("status").isin(OVER, UNDER)
    count = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    total = lambda cond, x: F.coalesce(F.sum(F.when(cond, x)), F.lit(0).cast("decimal(28,6)")).cast("double")
    hit = F.col("_hit")
    keys = ["geography_type", "geography_value", "train_dollar_recall", "train_precision", "train_n_flagged", "train_pct_flagged"]
    out = joined.groupBy(*keys).agg(
        total(sig, money).alias("test_total_error"), total(hit & error, money).alias("test_error_captured"), count(hit).alias("test_n_flagged"), count(hit & sig).alias("test_n_sig_errors_flagged"),
        count(hit & (F.col(amount) > 0)).alias("test_n_errors_flagged"), count(hit & ((F.col(over_flag) != 1) | (F.col(amount) == 0))).alias("test_n_false_positives"),
        F.count(F.lit(1)).alias("test_total_cases"), total(hit & sig, F.col(amount).cast(DOLLARS)).alias("_flat"),
    )
    c = F.col
    share = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(0.0)
    out = out.withColumns({"test_dollar_recall": share("test_error_captured", "test_total_error"), "test_precision": share("test_n_sig_errors_flagged", "test_n_flagged"), "test_pct_flagged": c("test_n_flagged") / c("test_total_cases"), "test_dollars_per_case": share("_flat", "test_n_sig_errors_flagged")})
    return out.withColumns({"recall_change": c("test_dollar_recall") - c("train_dollar_recall"), "precision_change": c("test_precision") - c("train_precision")}).drop("_flat")


def overall_summary(tested: DataFrame) -> DataFrame:
    """Recall weighted by dollars, precision weighted by flagged cases, and sums over geographies."""
    c = F.col
    dec = lambda x: F.sum(x.cast("decimal(28,9)")).cast("double")
    return tested.agg(
        F.count(F.lit(1)).alias("n_geographies"), ratio(dec(c("test_dollar_recall") * c("test_total_error")), dec(c("test_total_error"))).alias("recall"),
        ratio(dec(c("test_precision") * c("test_n_flagged")), F.sum("test_n_flagged")).alias("precision"), F.sum("test_n_flagged").alias("n_flagged"), F.sum("test_total_cases").alias("n_cases"),
        (dec(c("recall_change")) / F.count("recall_change")).alias("mean_recall_change"),
    )


def degraded(tested: DataFrame, by: float = -0.05) -> DataFrame:
    return tested.filter((F.col("recall_change") < by) | (F.col("precision_change") < by))


def pr_surface(cases: DataFrame, axes: Sequence[Axis], geo: str, positive: Column) -> DataFrame:
    """Confusion counts and rates of every rule for each geography.

    A case whose rule is unknown (some value is null, and none of the known ones fails) is in no cell. Counted twice, once with such cases
    left out and once with nulls meeting every bound, the cells give the flagged cases and those that may be flagged; negatives are the rest.
    """
    places = [f"_p{k}" for k in range(len(axes))]
    truth = F.coalesce(positive, F.lit(False)).cast("long")
    known = reduce(lambda a, b: a & b, (F.col(p).isNotNull() for p in places)).cast("long")
    base = cases.select(geo, *(a.place().alias(p) for a, p in zip(axes, places, strict=True)), truth.alias("pos"))
    totals = base.groupBy(geo).agg(F.sum("pos").alias("all_pos"), F.count(F.lit(1)).alias("all_n"))
    cells = base.withColumn("known", known).groupBy(geo, *places).agg(F.sum(F.col("pos") * F.col("known")).alias("tp"), F.sum("known").alias("flagged"), F.sum("pos").alias("may_pos"), F.count(F.lit(1)).alias("may_n"))
    found = unfold(cells, axes, [geo], ["tp", "flagged", "may_pos", "may_n"]).filter("flagged > 0").join(totals, geo)
    c = F.col
    found = found.withColumns({"fp": c("flagged") - c("tp"), "fn": c("all_pos") - c("may_pos"), "tn": (c("all_n") - c("all_pos")) - (c("may_n") - c("may_pos"))})
    return found.select(geo, *bounds_of(axes), "tp", "fp", "fn", "tn", ratio(c("tp"), c("tp") + c("fn")).alias("recall"), ratio(c("tp"), c("flagged")).alias("precision"), ratio(c("fp"), c("fp") + c("tn")).alias("fpr"), c("flagged").alias("n_pred_pos"))


def pr_tiers(surface: DataFrame, geo: str) -> DataFrame:
    """Best recall of each geography in each tier of precision, with ties, and whether the rate of false positives is below one half."""
    p = F.col("precision")
    tier = F.when(p >= 0.75, "high").when(p >= 0.5, "medium").when(p >= 0.33, "low").otherwise("very low")
    return top_with_ties(surface.withColumn("option", tier), [geo, "option"], [F.col("recall").desc_nulls_last()]).withColumn("meets_fpr", F.col("fpr") < 0.5)


def with_rule_columns(cases: DataFrame) -> DataFrame:
    """Add the columns that the rule templates test."""
    c = F.col
    return cases.withColumns({
        "earned_by_size": ratio(c("fsearn"), c("fsusize")), "unearned_by_size": ratio(c("fsunearn"), c("fsusize")), "gross_by_size": ratio(c("fsgrinc"), c("fsusize")), "deductions_by_size": ratio(c("fstotded"), c("fsusize")),
        "rawben_rel": ratio(c("rawben"), c("benmax")), "shelter_by_size": ratio(c("fssltexp"), c("fsusize")), "shelter_ratio": ratio(c("fssltexp"), c("fsgrinc") + 1), "other_by_size": ratio(c("fsothun"), c("fsusize")),
    })
