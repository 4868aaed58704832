"""DataFrame-to-DataFrame operators; every one works with ``df.transform``."""
