"""A rules-as-columns analytics engine on PySpark."""
