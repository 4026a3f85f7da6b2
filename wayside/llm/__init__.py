"""Operators for building language-model training data.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and gives DataFrames; ``queries`` applies them to whole tables.
"""
