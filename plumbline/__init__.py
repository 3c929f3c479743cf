"""Spark jobs for campaign-style scientific tables: tabular operators, tensor kernels, online statistics."""
