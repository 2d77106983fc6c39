"""A corpus engine on Spark: build, search and read large document collections."""
