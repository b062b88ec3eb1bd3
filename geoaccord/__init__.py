"""Agreement analytics for spatial data sources on Spark."""
