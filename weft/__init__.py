"""weft: text, keyword and ordered-path analytics as PySpark DataFrame operators."""
