"""turnlab: labelled-conversation analytics on Spark DataFrames."""
