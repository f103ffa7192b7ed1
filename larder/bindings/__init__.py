"""The library's roles (corpus, catalog, inventories, ...) bound to the test tables."""
