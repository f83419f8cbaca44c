"""loomgrid: array computation and corpus preparation as Spark DataFrame jobs."""
