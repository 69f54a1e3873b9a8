"""longtext: longitudinal text-corpus analytics on PySpark."""
