"""Kernel-trace analytics on Spark DataFrames.

Layout
------
``functions``  scalar column functions and name tables
``sources``    event tables in, decoded classes, dimensions, metric samples out
``operators``  as-of attribution, entity intervals, per-CPU pairing, histograms, scrapes
``plans``      the metric families built from the operators
``streaming``  the same plans over micro-batches
"""

__version__ = "0.1.0"
