"""nasaq: an Arabic-aware text search and counting engine on PySpark."""
