"""Pure Python kernels: no Spark here, so they test fast and ship to executors as they are."""
