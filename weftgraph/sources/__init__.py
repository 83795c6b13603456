"""Where tables come from and where intermediate results are kept."""
