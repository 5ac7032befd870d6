"""webfacts: page facts, vector and text search, scoring and metric series as Spark jobs."""
