"""Personal-finance analytics expressed as Spark DataFrame plans."""
