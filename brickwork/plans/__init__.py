"""End-to-end studies composed from operators."""
