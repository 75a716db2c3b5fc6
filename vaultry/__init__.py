"""vaultry: analytics over trees of Markdown notes, expressed as Spark DataFrames."""
