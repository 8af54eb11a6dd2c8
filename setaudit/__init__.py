"""setaudit: audit collections of files against catalogues, on Spark DataFrames."""
