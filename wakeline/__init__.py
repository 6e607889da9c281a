"""wakeline: vessel tracks and water geometry as Spark DataFrames."""
