"""Operators: functions from DataFrames (of whole batches of queries, documents, pages ...) to DataFrames."""
