"""Multi-sensor track analytics and corpus preparation on Spark."""
