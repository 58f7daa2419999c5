"""Template matching over rasters, declared as Spark plans."""

ENGINE = "rastermill"
