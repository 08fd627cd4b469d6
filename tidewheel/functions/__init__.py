"""Column-level building blocks: expressions, reductions, periods, ordered access."""
