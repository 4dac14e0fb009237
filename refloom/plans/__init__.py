from refloom.plans import catalog, flow_queries, record_queries  # noqa: F401  (both add to the catalog)
