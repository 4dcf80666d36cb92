"""Query and cleaning engine for announcement-style web content, on Spark DataFrames."""
