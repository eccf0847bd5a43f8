"""tapegrid: intraday market-data analytics as lazy Spark DataFrame operators."""
