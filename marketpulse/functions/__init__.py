"""Column functions. All but the drawn vectors are built-in expressions."""
