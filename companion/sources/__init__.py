"""Sources and sinks: record files, CSV tables, and the fixture mapping."""
