"""loomdial: dialogue-corpus analytics on Spark DataFrames."""
