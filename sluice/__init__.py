"""Data-quality, privacy and reconciliation checks over record sets, as Spark column expressions, joins and aggregates."""
