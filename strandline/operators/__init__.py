"""Set-based event operators: DataFrame in, DataFrame out."""
