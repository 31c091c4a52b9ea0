"""Index definitions, query parsing and the compiler from queries to DataFrames."""
