"""Log views over tables, and the end-to-end flows."""
