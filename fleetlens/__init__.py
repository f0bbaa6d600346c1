"""Fleet evidence analytics on PySpark: DataFrame operators over a corpus table."""
