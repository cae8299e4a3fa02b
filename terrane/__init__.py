"""terrane: map tiles, features, boundaries, archives and elevation as DataFrames, with a Spark plan for every question."""
