"""rillflow: daily series, river graphs, skill metrics and training tables on Spark."""
