"""Text cleaning, record matching and report assembly as Spark DataFrame expressions."""
