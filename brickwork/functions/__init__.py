"""Column builders; nothing in this package triggers a job."""
