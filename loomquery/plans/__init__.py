"""From a request to a plan: validation, search, catalog of namespaces."""
