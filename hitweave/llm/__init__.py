"""Training-data operators; each module documents its own rules for nulls, ties and empty input."""
