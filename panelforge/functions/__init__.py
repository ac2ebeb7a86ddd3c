"""Column expressions on row-major matrix arrays, and the dense numerics behind a few of them."""
