"""A PySpark engine for questions about the quality of code and text."""
