"""Wayside: a PySpark engine for roadside vehicle-passage records.

Everything is a ``DataFrame -> DataFrame`` function built from Spark's own
expressions, joins, aggregates and writers.  Run dates and clocks are always
arguments, so a rerun gives the same table.
"""
