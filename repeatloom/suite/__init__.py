"""Check queries over the given tables."""

from repeatloom.suite import interval_checks, motif_checks, plan_checks, scalar_checks, summary_checks  # noqa: F401

FLAGSHIP = "q03_human_survey"
