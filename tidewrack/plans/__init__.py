"""The query language, the search plan, and the registered workload."""
