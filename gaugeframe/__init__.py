"""Conformity and similarity analytics over descriptor tables, written as Spark jobs."""
