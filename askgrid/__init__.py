"""Schema-aware question answering and reporting over Spark tables."""
