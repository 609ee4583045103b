"""Analytics over document and knowledge-base corpora, written as Spark DataFrame queries."""
