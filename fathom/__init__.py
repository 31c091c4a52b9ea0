"""Search and analytics over DataFrames: operators, analysis, facets, vectors and streams as Spark plans."""
