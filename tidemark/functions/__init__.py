"""Row-wise column expressions."""
