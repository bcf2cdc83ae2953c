"""Profiles, questions, charts, advice, conversations and the event audit."""
