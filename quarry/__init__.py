"""A PySpark engine for documents: extraction, splitting and re-assembly."""
