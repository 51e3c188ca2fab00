"""Analytics on recorded runs: trajectories, sensor streams, route choices and rasters, as Spark plans."""
