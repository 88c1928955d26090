"""plinth: a Spark-first engine for official price statistics and corpus preparation."""
