"""Media-library analytics on Spark: typed tables and DataFrame operators over them."""
