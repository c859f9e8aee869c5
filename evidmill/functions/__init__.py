"""Column library shared by the operators."""
