"""Analytics over source trees, documents and markup, as Spark DataFrames."""
