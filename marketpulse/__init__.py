"""Market-sentiment analytics over social posts, as Spark jobs."""
