"""tessera: governed, versioned knowledge as Spark DataFrames."""
