"""Model-driven temporal queries on Spark: entities mapped to tables, typed finders, DataFrame plans."""
