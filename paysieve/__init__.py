"""paysieve: web-payload analytics expressed as Spark DataFrame jobs."""
