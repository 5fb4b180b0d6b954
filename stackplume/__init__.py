"""Spark-native analytics for industrial emission and air-quality tables.

Every public function takes DataFrames (or Columns) and parameters and returns
DataFrames (or Columns).  Nothing here reads the wall clock or keeps global
state; only single rows of statistics and fitted models reach the driver.
"""
