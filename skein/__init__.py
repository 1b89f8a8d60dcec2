"""Analytics over chat-style message feeds, on Spark DataFrames."""
