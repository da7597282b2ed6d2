"""latticeflow: a PySpark engine for voxel-lattice, multi-tensor, labelled-vector and sparse-graph data."""
