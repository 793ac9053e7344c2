"""Point-in-time market research as Spark DataFrame pipelines."""
