"""Writers: partitioned tables, insert-only upsert, append with deduplication, CSV."""
