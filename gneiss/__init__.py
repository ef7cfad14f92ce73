"""gneiss: an evidence and text-search engine expressed as Spark DataFrames."""
