"""Array, matrix, grid, change-set and discrete-event workloads as Spark DataFrame operators."""
