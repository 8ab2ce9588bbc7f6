"""Part of weftline, a PySpark library."""
