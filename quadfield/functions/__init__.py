"""Column functions: IEEE arithmetic, field expressions and Arrow kernels."""
