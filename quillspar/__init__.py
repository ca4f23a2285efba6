"""quillspar: structural analytics and corpus preparation as Spark DataFrames."""
