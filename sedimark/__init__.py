"""A PySpark engine for research documents, claims, prices, workbooks and session logs."""
