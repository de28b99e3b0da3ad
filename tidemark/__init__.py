"""tidemark: reconcile very large file inventories and analyse the run behind them, on Spark."""
