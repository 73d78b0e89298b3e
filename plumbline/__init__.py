"""Analytics over collections of AI-generated answers, as Spark DataFrame operators."""
