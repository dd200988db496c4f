"""Training-data operators: one module per operator, each a DataFrame-in, DataFrame-out function."""
