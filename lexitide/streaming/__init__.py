"""Structured Streaming forms of the monthly counts and of experience, which the batch operators also compute."""
