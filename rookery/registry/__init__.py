"""Every operator as a query on star-schema files, and the same question in SQL."""
