"""docsect: a documentation-section index and retrieval engine on PySpark."""
