"""wakeline: trajectory and corpus analytics written as Spark DataFrame jobs."""
