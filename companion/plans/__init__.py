"""End-to-end pipelines (PL1-PL4) and the registered queries."""
