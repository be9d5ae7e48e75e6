"""Column expressions: text, numbers, survey codes, hashes and privacy checks."""
