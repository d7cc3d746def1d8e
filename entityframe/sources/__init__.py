"""Where tables come from: Parquet folders, catalogues, DataFrames, CSV files and GraphQL endpoints."""
