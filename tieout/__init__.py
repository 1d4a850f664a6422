"""Before-and-after reconciliation on Spark: matching, control totals, decision tables and data checks as DataFrames."""
