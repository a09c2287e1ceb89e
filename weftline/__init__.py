"""Web knowledge-graph and corpus jobs for Spark."""
