"""A Spark-first search-and-browse engine over a URI tree of objects."""
