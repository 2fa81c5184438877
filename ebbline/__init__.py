"""Change-log analytics on Spark: logs of row images as DataFrames, with operators that fold, filter, assemble and compare them."""
