"""Oracle-checked queries over the driver tables.

``views`` shapes the driver tables into the library's inputs, once as DataFrames and once as
SQL text. The query modules pair a Spark query with SQL that states the same result.
"""
