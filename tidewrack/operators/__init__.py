"""DataFrame to DataFrame operators of the search engine."""
