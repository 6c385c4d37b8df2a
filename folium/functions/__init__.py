"""Scalar functions as Spark columns; pandas UDFs only where no built-in can say it."""
