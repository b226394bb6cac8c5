"""Matching, line selection, context and summaries over DataFrames of lines."""
