"""Spark-native operators for chart-classification analytics.

Every public function takes and returns DataFrames (or Columns) and runs on
Spark SQL, window functions and spark.ml.
"""
