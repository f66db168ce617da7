"""Crosstide: factor analytics on daily panels, written as Spark plans.

A panel is a DataFrame with one row per (datetime, instrument).  Functions in
``crosstide.functions`` map Columns to Columns; functions in
``crosstide.operators`` and ``crosstide.plans`` map DataFrames to DataFrames.
"""
