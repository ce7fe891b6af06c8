"""Column expressions: vectors, summaries, grid cells, the normal quantile."""
