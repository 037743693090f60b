"""lexiflow: document-translation state at corpus scale, on Spark DataFrames."""
