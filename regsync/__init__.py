"""regsync: registry reconciliation and corpus preparation on Spark DataFrames."""
