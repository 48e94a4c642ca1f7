"""Document-injection screening over DataFrames."""
