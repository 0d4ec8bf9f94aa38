"""Retail sales analytics as Spark DataFrame jobs.

``functions``  column expressions: revenue measures, labels, exact sums
``sources``    typed tables, dump loader, JDBC, bucketed and plain writers
``operators``  rank, running total, share, growth, top-n, threshold flags
``plans``      the named analyses, report figures, dimensional model, quality jobs
"""
