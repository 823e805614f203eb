"""Storage of namespaces: change log, segments, manifests, tombstones."""
