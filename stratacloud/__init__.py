"""Octree indexing, level-of-detail thinning and quality checks for large 3-D point clouds on Spark."""
