"""tessera: a PySpark-native engine that catalogs, audits and de-duplicates media libraries."""
