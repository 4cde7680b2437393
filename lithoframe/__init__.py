"""lithoframe: subsurface analytics as Spark DataFrames."""
