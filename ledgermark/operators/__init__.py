"""Set-at-a-time reconciliation operators: DataFrame in, DataFrame out."""
