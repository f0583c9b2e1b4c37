"""laminar: cohort-scale measurement of layered scans, and corpus preparation, on Spark DataFrames."""
