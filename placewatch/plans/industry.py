"""Industry statistics: pivot of measures, names, guarded ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import per_head, ratio_pct
from ..operators.aggregates import pivot_first
from ..operators.reshape import normalise_names, pick_column

# Measure codes of the statistics and the columns they fill.
MEASURES = {"EMPTOTAL": "num_employees_thousand", "INCTOTAL": "total_income_aud_m",
            "INCSALGDSSERV": "sales_service_income_aud_m", "INDUSTRY": "industry_value_added_aud_m",
            "EBITDA": "ebitda_aud_m", "OPBT": "operating_profit_aud_m", "LABCOSTTOT": "total_labour_costs_aud_m",
            "EXPLCWAGESNA": "wages_salaries_aud_m", "EXPTOTAL": "total_expenses_aud_m",
            "PURCHASES": "purchases_aud_m", "EXPLCSUP": "super_contributions_aud_m"}


def industry_context(raw: DataFrame, names: DataFrame, measures: dict[str, str] = MEASURES,
                     codes: str | None = None, latest: str = "global") -> DataFrame:
    """One row per industry code of the latest year, a column per known measure, names attached.

    ``raw`` is all text. ``codes`` is a pattern for the codes to keep;
    ``latest`` = ``global`` takes the newest year of the file, ``filtered`` that
    of the kept codes and measures.
    """
    df = normalise_names(raw)
    code = pick_column(df, "industry", "anzsic", "industry_code")
    measure, time = pick_column(df, "measure", "m"), pick_column(df, "time_period", "time", "period")
    value = pick_column(df, "obs_value", "value")
    kept = df if codes is None else df.where(F.col(code).rlike(codes))
    kept = kept.where(F.col(measure).isin(*measures))
    year = (df if latest == "global" else kept).agg(F.max(time)).scalar()
    rest = [c for c in df.columns if c not in (code, measure, time, value) and not c.startswith("_")]
    rows = kept.where(F.col(time) == year).withColumn("_value", F.col(value).try_cast("double"))
    wide = pivot_first(rows, [code, time], measure, "_value", measures, [*rest, "_value"])
    out = wide.withColumnsRenamed({code: "anzsic_code", time: "reference_year"})
    return out.join(names.select("anzsic_code", "anzsic_name"), "anzsic_code", "left").select(
        "anzsic_code", "anzsic_name", "reference_year", *measures.values())


def industry_struct(keys: DataFrame, context: DataFrame) -> DataFrame:
    """(code, result): figures and ratios of each asked code, error text for unknown codes."""
    asked = keys.withColumn("anzsic_code", F.trim("code"))
    found = asked.join(context.withColumn("_hit", F.lit(True)), "anzsic_code", "left")
    income = "total_income_aud_m"
    error = F.when(F.col("_hit").isNull(), F.concat(
        F.lit("ANZSIC code "), F.col("anzsic_code"),
        F.lit(" not found in our industry data. Use a 2-digit Subdivision code like 01, 45, 43.")))
    return found.select("code", F.struct(
        "anzsic_code", "anzsic_name", "reference_year", "num_employees_thousand", income,
        "industry_value_added_aud_m", "operating_profit_aud_m", "wages_salaries_aud_m",
        per_head(income, "num_employees_thousand").alias("revenue_per_employee_aud"),
        ratio_pct("wages_salaries_aud_m", income).alias("wages_share_of_income_pct"),
        ratio_pct("ebitda_aud_m", income).alias("ebitda_margin_pct"),
        ratio_pct("industry_value_added_aud_m", income).alias("value_added_intensity_pct"),
        error.alias("error")).alias("result"))
