"""Tables: Parquet snapshots named by a manifest, and relations registered from outside."""
