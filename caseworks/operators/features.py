"""Feature pipeline of a case review: population filters, recovery of what was on file before a correction, household features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseworks.functions.semantics import any_of, at_least, at_most, count_where, highest, in_set, lowest, overwrite, ratio, trimmed, truncated

# Names of income elements in the case file.
EARNED_ELEMENTS = ["wages and salaries", "self-employment", "other earned income"]
UNEARNED_ELEMENTS = [
    "rsdi benefits", "veterans' benefits", "ssi and/or state ssi supplement", "unemployment compensation", "workers' compensation",
    "other government benefits", "contributions", "deemed income", "tanf, pa, or ga", "educational grants/scholarships/loans",
    "other unearned income", "child support payments received from absent parent",
]
CORRECT, OVER, UNDER = "amount correct", "overissuance", "underissuance"

# Employment statuses by the group they are reported in.
LABOUR_GROUPS = {
    "not in labor force": ["Not in labor force and not looking for work"],
    "unemployed and searching": ["Unemployed and looking for work"],
    "other": ["Active-duty military", "Migrant farm laborer", "Nonmigrant farm laborer", "Self-employed, farming"],
    "self-employed": ["Self-employed, nonfarming"],
    "employed by other": ["Employed by other"],
}
# Codes by the group they are reported in; other codes give null.
ORIGIN_GROUPS = {
    "Hispanic": [
        "hispanic_ai_an", "hispanic_ai_an_and_black", "hispanic_ai_an_and_white", "hispanic_asian", "hispanic_asian_and_white", "hispanic_black_and_white",
        "hispanic_black_or_african_american", "hispanic_multiple_races_other", "hispanic_native_hawaiian_or_pacific_islander", "hispanic_white",
    ],
    "American Indian or Alaska Native": ["not_hispanic_american_indian_or_alaska_native"],
    "Black": ["not_hispanic_black_or_african_american", "not_hispanic_black_and_white"],
    "White": ["not_hispanic_white"],
    "AAPI": [
        "not_hispanic_native_hawaiian_or_pacific_islander", "not_hispanic_ai_an_and_black", "not_hispanic_asian", "not_hispanic_asian_and_white",
        "not_hispanic_ai_an_and_white",
    ],
    "missing": ["race_ethnicity_not_available_application_not_found", "race_ethnicity_not_recorded"],
}


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, if it has the columns; a missing feature is an error, not a null."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def recode(col: Column, groups: dict[str, list[str]]) -> Column:
    """Group that a value belongs to; null for values of none."""
    out = None
    for name, values in groups.items():
        out = F.when(in_set(col, values), name) if out is None else out.when(in_set(col, values), name)
    return out


def overpayment(status: Column, over_threshold: Column) -> Column:
    """1 for an overissuance above the threshold, 0 otherwise, null where that is unknown."""
    hit = (status == OVER) & (over_threshold == 1)
    return F.when(hit.isNull(), None).when(hit, 1).otherwise(0)


def reconcilable(df: DataFrame, tolerance: float = 5) -> DataFrame:
    """Correct cases, and errors whose amount is the difference of the two benefits within the tolerance."""
    return df.filter((F.col("status") == CORRECT) | (F.abs(F.abs(F.col("fsben") - F.col("rawben")) - F.col("amterr")) <= tolerance))


def income_errors(df: DataFrame) -> DataFrame:
    """Cases whose first element is one of income (as spelled), and correct ones; correct cases with an error amount go."""
    correct = F.coalesce(F.col("status") == CORRECT, F.lit(False))
    kept = df.filter(in_set(F.col("element1"), EARNED_ELEMENTS + UNEARNED_ELEMENTS) | correct)
    return kept.filter(~((F.col("status") == CORRECT) & (F.col("amterr") > 0)))


def feasible(df: DataFrame) -> DataFrame:
    return df.filter(F.col("rawben") <= F.col("benmax"))


def recover_income(df: DataFrame) -> DataFrame:
    """Add what was on file before the correction, the benefit that it implies, and how well that matches.

    The corrected benefit gives the net income it was computed from; in the category that was in error the gross income then follows
    from deductions, of which one part is a fifth of earnings.
    """
    c = F.col
    first = F.lower("element1")
    correct = F.coalesce(c("status") == CORRECT, F.lit(False))
    df = df.withColumns({"has_earned_inc_error": in_set(first, EARNED_ELEMENTS), "has_unearned_inc_error": in_set(first, UNEARNED_ELEMENTS)})
    floor_net = (c("benmax") - c("minimum_ben")) / F.lit(0.30)
    df = df.withColumn("original_net_income", F.when(correct, c("fsnetinc")).when(c("rawben") <= c("minimum_ben"), floor_net).otherwise((c("benmax") - c("rawben")) / F.lit(0.30)))
    net = c("original_net_income")
    earned = at_least((net - c("fsunearn") + c("fstotded") - F.lit(0.20) * c("fsearn")) / F.lit(0.80), 0)
    unearned = at_least(net - c("fsearn") + c("fstotded"), 0)
    df = df.withColumns({"recovered_earned": F.when(c("has_earned_inc_error"), earned).otherwise(c("fsearn")), "recovered_unearned": F.when(c("has_unearned_inc_error"), unearned).otherwise(c("fsunearn"))})
    deductions = c("fstotded") - F.lit(0.20) * c("fsearn") + F.lit(0.20) * c("recovered_earned")
    df = df.withColumn("original_deductions", F.when(c("has_earned_inc_error"), deductions).otherwise(c("fstotded")))
    df = df.withColumn("verified_gross", c("recovered_earned") + c("recovered_unearned"))
    df = df.withColumn("verified_net", c("verified_gross") - c("original_deductions"))
    implied = c("benmax") - F.lit(0.30) * c("verified_net")
    implied = F.when(implied.isNull(), None).otherwise(F.greatest(c("minimum_ben"), implied))
    df = df.withColumn("verified_benefit", F.when(c("verified_net") <= 0, c("benmax")).otherwise(implied))
    gap = F.when(correct, F.abs(c("verified_benefit") - c("fsben"))).otherwise(F.abs(c("verified_benefit") - c("rawben")))
    return df.withColumn("benefit_gap", gap).withColumn("good_match", c("benefit_gap") < 1)


def error_strata(df: DataFrame) -> DataFrame:
    """Add error_category, status_clean and error_status, the stratum that trees are grown in."""
    category = F.when(F.col("has_earned_inc_error"), "earned_income").when(F.col("has_unearned_inc_error"), "unearned_income").otherwise("other")
    df = df.withColumn("error_category", category).withColumn("status_clean", F.lower(trimmed(F.col("status"))))
    over, under = F.col("status_clean") == OVER, F.col("status_clean") == UNDER
    income = F.col("error_category") != "other"
    stratum = F.when(income & under, UNDER).when((F.col("error_category") == "earned_income") & over, "earned_overissuance")
    return df.withColumn("error_status", stratum.when((F.col("error_category") == "unearned_income") & over, "unearned_overissuance"))


def uncapped_ratio() -> Column:
    """Benefit that the recovered amounts imply, without floor or cap, over the maximum."""
    c = F.col
    return ratio(c("benmax") - F.lit(0.3) * (c("recovered_earned") + c("recovered_unearned") - c("original_deductions")), c("benmax"))


def capped_ratio() -> Column:
    share = ratio(F.col("rawben"), F.col("benmax"))
    return overwrite(share, share > 1, F.lit(1.0))


def per_person(col: Column) -> Column:
    return ratio(col, F.col("fsusize"))


def shelter_ratio() -> Column:
    return truncated(ratio(F.col("fssltexp"), F.col("verified_gross") + 1))


def type_count(columns: Sequence[str]) -> Column:
    """Number of columns with a positive amount."""
    return count_where(F.col(c) > 0 for c in columns)


def round_numbers(columns: Sequence[str], unit: int = 10) -> Column:
    """Number of positive amounts that the unit divides."""
    return count_where((F.col(c) > 0) & (F.col(c) % unit == 0) for c in columns)


def labour_force(ages: Sequence[str]) -> Column:
    """Composition of a household by ages; one without any known age counts as all of working age."""
    low, high = lowest([F.col(a) for a in ages]), highest([F.col(a) for a in ages])
    return F.when((low > 17) & (high < 60), "all working age").when((high < 18) | (low > 59), "no working age").otherwise("mixed age")


def household_flags(df: DataFrame, relations: Sequence[str]) -> DataFrame:
    elderly, disabled = F.col("elderly_present") == 1, F.col("fsndis") > 0
    return df.withColumns({
        "expedited": F.col("expedser") < 3, "disabled": disabled, "married": any_of([F.col(r) for r in relations], ["Spouse"]).cast("int"),
        "homeless": F.col("homeded") != "Not homeless", "elderly_or_disabled": elderly | disabled,
    })


def outcome_class() -> Column:
    """amount correct, then uncounted error, then counted error: the later test wins."""
    base = F.when(F.col("status") == CORRECT, F.lit("amount correct"))
    base = overwrite(base, (F.col("error_flag") == 1) & (F.col("status") != CORRECT), F.lit("uncounted_error"))
    return overwrite(base, (F.col("over_threshold") == 1) & (F.col("status") != CORRECT), F.lit("above_threshold_error"))


def at_certification(df: DataFrame, actions: Sequence[str] = ("certification",)) -> DataFrame:
    timely = F.col("timeper1") == "at time of most recent action by agency"
    action = in_set(F.col("actntype"), actions)
    return df.filter((timely & action) | ((F.col("status") == CORRECT) & action))


def rescaled_weight(weight: str = "fywgt", by: Sequence[str] = ("state", "year")) -> Column:
    """Weight over its group's mean, which is taken in exact decimals."""
    group = W.partitionBy(*by)
    mean = F.sum(F.col(weight).cast("decimal(28,6)")).over(group).cast("double") / F.count(weight).over(group)
    return F.col(weight) / mean


def prepare_cases(cases: DataFrame, details: DataFrame, policy: DataFrame) -> DataFrame:
    """Join case files with details and state policy, keep reconcilable income errors and correct cases, recover income and add features.

    The policy table has a row for each state and is small by nature; details join by case, in sort order, as they
    are as many as the cases, however few bytes they take.
    """
    base = cases.drop("over_threshold").join(details.select("case_id", "over_threshold", "error_threshold").hint("merge"), "case_id")
    base = base.join(policy, base["state"] == policy["State"]).drop(policy["State"])
    base = base.filter("year BETWEEN 2017 AND 2023 AND status IS NOT NULL")
    df = error_strata(recover_income(feasible(income_errors(reconcilable(base)))))
    df = df.withColumns({"payment_error": overpayment(F.col("status"), F.col("over_threshold")), "ratio_uncapped": uncapped_ratio(), "ratio_capped": capped_ratio()})
    size = ratio(F.col("ctprhh"), F.col("fsusize"))
    return df.withColumns({"hh_size_ratio": size, "earned_per_person": per_person(F.col("recovered_earned")), "unearned_per_person": per_person(F.col("recovered_unearned")), "deductions_per_person": per_person(F.col("original_deductions")), "gross_per_person": truncated(per_person(F.col("verified_gross"))), "shelter_to_gross": shelter_ratio()})


def match_report(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cases, share of good matches in percent, and mean, median and largest gap between verified and observed benefit."""
    gap = F.col("benefit_gap")
    mean = F.sum(gap.cast("decimal(28,6)")).cast("double") / F.count(gap)
    good = F.sum(F.col("good_match").cast("long")) * F.lit(100.0) / F.count("good_match")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), good.alias("pct_good"), mean.alias("mean_gap"), F.median(gap).alias("median_gap"), F.max(gap).alias("max_gap"))
