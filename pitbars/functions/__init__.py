"""Column expressions: scalars, rolling features, rule trees."""
