"""tallyforge: SQL audit, trajectory analytics and data preparation on Spark."""
