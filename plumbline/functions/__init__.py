"""Functions on columns: geometry and text labels."""
