"""paddock: leak-safe as-of features, group-wise ranking and data audits as PySpark DataFrame operators."""
