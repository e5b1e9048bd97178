"""Programs over the operators: the SQL dialect and ready jobs."""
