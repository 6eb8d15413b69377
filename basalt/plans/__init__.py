"""Registered queries, by topic, each beside its oracle SQL."""
