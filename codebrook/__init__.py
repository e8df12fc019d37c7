"""Product-quantization and approximate matrix products as Spark DataFrame plans."""
