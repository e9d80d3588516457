"""trellisq: graph-pattern analytics on Spark DataFrames.

The package compiles SPARQL 1.1 SELECT queries over a set of
subject-predicate-object triples to ordinary DataFrame plans.
"""
