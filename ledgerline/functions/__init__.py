"""Expressions: resolved predicates as Spark columns and as driver-side tests of single rows."""
