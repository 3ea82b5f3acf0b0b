"""Training-data pipeline operators: extraction, filtering, deduplication, scanning and tokenization."""
