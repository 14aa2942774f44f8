"""Where documents live: versioned Parquet collections, backups and inspection."""
