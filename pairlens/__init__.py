"""pairlens: paired before/after analytics as Spark DataFrame operators."""
