"""DataFrame operators: quality checks, facts, customers, categories, sellers, ranks, extracts."""
