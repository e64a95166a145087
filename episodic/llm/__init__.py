"""Operators for preparing language-model training text; nothing else in episodic imports this."""
