"""Path access and JSON rendering as Spark SQL expressions."""
