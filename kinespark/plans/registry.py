"""All queries of the library with their SQL, by name."""

from kinespark.plans import comparison_plans, evaluation, model_plans, policy_plans, quality_plans, report_plans, signal_plans, stat_plans  # noqa: F401  (they fill the register)
from kinespark.plans.register import QUERIES, SQL

FLAGSHIP = "f29_participant_trend"


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict:
    return SQL
