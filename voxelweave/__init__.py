"""Spark-first analytics over octree-organised point clouds."""
