"""Command analytics on Spark: a log of agent commands as data, folded with DataFrames."""
