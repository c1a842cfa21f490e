"""Training-data operators: quality, duplicates, packing, scoring and formatting of text corpora on Spark."""
