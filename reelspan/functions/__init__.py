"""Part of the recording analytics engine; see README.md."""
