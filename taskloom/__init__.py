"""taskloom: frame-level episode data, annotations, question-answer rows and metrics as Spark DataFrames."""
