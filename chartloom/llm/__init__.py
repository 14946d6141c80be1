"""Operators of a training-data pipeline. Nothing outside this subpackage imports it.

Every operator takes and returns DataFrames. Text work is done on the byte buffers of Arrow batches inside Spark
tasks (``arrays``); Spark partitions, shuffles, joins and aggregates.
"""
