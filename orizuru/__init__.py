"""orizuru: a Spark-first analytics engine for rated works and the people credited on them."""
