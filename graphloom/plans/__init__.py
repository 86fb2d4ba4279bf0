"""Registered queries, their oracle SQL, and the derived views they run on."""
