"""Copy-number and structural-variant analytics as Spark jobs over whole cohorts."""
