"""fieldloom: displacement and strain fields from frame sequences, and training-data operators, on Spark."""
