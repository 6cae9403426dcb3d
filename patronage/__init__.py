"""Customer analytics on Spark: landing, identity, marts, scores, predictions.

Every operator takes DataFrames and returns a DataFrame, for all tenants at
once. Money is integer paise, times are zone-less UTC, and every "now" is the
newest order of the tenant, never the wall clock.
"""
