"""Tables, registries, policies and persisted results."""
