"""voxelake: a Spark-native store, query and maintenance engine for medical-imaging series."""
