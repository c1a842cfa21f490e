"""hslake: observed network-cryptography evidence and training-corpus operators on Spark DataFrames."""
