"""Tandem-repeat and interval analytics on Spark DataFrames.

Every public function takes Columns or DataFrames and returns Columns or
DataFrames.  Coordinates are 0-based and half-open everywhere; file readers
convert once, at the source.
"""
