"""Session-level helpers shared by the operators."""
