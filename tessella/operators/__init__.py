"""What changes tables and says who may: rows, schemas, access, settings."""
