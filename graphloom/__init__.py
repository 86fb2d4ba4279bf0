"""graphloom: deterministic code- and document-graph analytics on PySpark."""
