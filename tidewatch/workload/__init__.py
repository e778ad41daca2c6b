"""The registered queries: operators over tables derived from the given Parquet files."""
