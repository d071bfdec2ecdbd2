"""Static-analysis findings on Spark: ingest, vote across tools, densities, distributions and statistics."""
