"""Record intake, triage and governance on Spark DataFrames."""
