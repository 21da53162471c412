"""citewright: evidence retrieval, ranking and verification as Spark DataFrame plans."""
