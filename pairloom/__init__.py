"""Preference data on Spark: prompts, budgets, splits, encodings, scores."""
