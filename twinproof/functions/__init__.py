"""Column-level building blocks; everything here stays inside Spark expressions unless noted."""
