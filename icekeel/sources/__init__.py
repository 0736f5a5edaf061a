"""Sources and sinks: Avro container files, stores, catalogs, Parquet."""
