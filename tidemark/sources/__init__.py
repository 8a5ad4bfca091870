"""Sources (binary files, PDF text) and the versioned snapshot store."""
