"""Column functions: bytes, tags, hashes, histogram buckets."""
