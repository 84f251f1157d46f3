"""Where tables come from: the driver's Parquet files, the warehouse projected from them, and JSON records."""
