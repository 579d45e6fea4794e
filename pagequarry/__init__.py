"""Analytics for large collections of web pages, as Spark DataFrame operators."""
