"""statloom: declarative statistics over Spark DataFrames."""
