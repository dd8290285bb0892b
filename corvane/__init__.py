"""Question-corpus and assessment analytics as DataFrame-to-DataFrame operators."""
