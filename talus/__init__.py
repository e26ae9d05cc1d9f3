"""talus: an analytics engine written as Spark DataFrame and SQL jobs."""
