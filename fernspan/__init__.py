"""fernspan: a Spark-first analytics engine (message triage, invoice control, FX exposure, tabular and vector analytics)."""
