"""Column functions: pure expressions that stay in whole-stage code generation."""
