"""Training-data operators: scoring, tokenising, filtering and joining text at corpus scale."""
