"""Operators over DataFrames: chunking, retrieval, context, graphs, lifecycle, evaluation, usage, paging, filters, security."""
