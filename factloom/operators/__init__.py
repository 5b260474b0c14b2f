"""Domain operators: DataFrame in, DataFrame out; errors are rows with codes."""
