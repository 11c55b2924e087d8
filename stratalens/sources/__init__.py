"""Reading and writing files: detection, ingest, cache, exports."""
