"""Event-time analytics on Spark: keyed counts, windows, interval joins, views and change capture.

Every transform takes static and streaming DataFrames alike and returns a lazy DataFrame.
"""
