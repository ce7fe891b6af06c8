"""tidepool: clustering of data streams and tables, expressed as Spark jobs.

Online steps fold rows into small summaries (micro-clusters, density-grid cells, weighted
coresets); offline steps turn the summaries into final clusters and score them.  All row-sized
work is declared on DataFrames; the summaries are DataFrames too and live in a versioned
parquet store between micro-batches.
"""

__version__ = "0.1.0"
