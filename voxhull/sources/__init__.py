"""Sources and sinks of meshes, grids, equations and weights."""
