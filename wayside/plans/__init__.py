"""Multi-step jobs: ingest, day refresh, backfill, history rewrite."""
