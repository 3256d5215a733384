"""The log as a stream: followers, deduplication, sessions, and keyed state for producers and leases."""
