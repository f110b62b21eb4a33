"""Schema-directed XML for Spark: XSD in, typed DataFrames and schema-conformant XML out."""
