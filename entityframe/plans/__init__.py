"""From queries to DataFrames, and the catalogue of registered queries."""
