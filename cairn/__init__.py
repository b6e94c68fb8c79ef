"""Knowledge-graph retrieval, code-graph queries and corpus statistics as Spark DataFrames."""
