"""Training-data operators: deduplication, quality, language, chat, scoring, extraction."""
