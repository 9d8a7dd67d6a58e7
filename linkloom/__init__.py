"""Link discovery over stored web crawls, expressed as Spark DataFrame jobs."""
