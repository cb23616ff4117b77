"""Session handling, type mapping and the missing-value rules."""
