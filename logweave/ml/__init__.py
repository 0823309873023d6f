"""pyspark.ml surface of the operators."""
