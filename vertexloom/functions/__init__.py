"""Reports on results, and comparisons of them."""
