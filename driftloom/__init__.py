"""Text-collapse analytics as PySpark DataFrame operators."""
