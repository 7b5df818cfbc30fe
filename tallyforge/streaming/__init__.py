"""Stateful operators on streams: resumable ingestion, ledgers, group filters, and windows by count or event time."""
