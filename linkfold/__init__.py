"""Link compression, storage and analysis on Spark."""
