"""tilewright: asset catalogues and raster tables on Spark DataFrames."""
