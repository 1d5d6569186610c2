"""hydrospark: DataFrame operators for flood and hydrology analytics on Spark."""
