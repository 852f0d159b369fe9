"""Package supply-chain risk analytics as Spark DataFrame jobs."""
