"""A Spark-first analytics engine for point clouds, meshes, mesh graphs and implicit fields."""
