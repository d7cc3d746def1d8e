"""Scalar functions as Spark columns, with the results that the reference's SQL engine gives."""
