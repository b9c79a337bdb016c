"""Storage: the operation log and the versioned key-value log."""
