"""deliverylens: webhook delivery reliability analytics as Spark DataFrame jobs."""
