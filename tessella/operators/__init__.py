"""Panel operators: DataFrame to DataFrame."""
