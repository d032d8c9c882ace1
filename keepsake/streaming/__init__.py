"""The same semantics over streams."""
