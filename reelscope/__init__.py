"""Short-form media analytics expressed as Spark DataFrame operators."""
