"""millrace: corpus analytics and curation as lazy Spark DataFrame computations."""
