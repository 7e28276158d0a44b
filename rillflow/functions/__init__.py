"""Cell-wise algebra, statistics and array functions."""
