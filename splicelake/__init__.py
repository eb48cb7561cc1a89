"""splicelake: spliced-alignment analytics as PySpark DataFrame operators."""
