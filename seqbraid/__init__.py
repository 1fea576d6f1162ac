"""seqbraid: clustering of short strings and corpus operators on PySpark."""
