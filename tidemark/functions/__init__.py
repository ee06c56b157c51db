"""Column expressions; none of them touches rows outside its own."""
