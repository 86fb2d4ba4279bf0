"""Where files, commits and graphs come from, and where they go."""
