"""A retrieval, text-analytics and data-preparation engine expressed as Spark DataFrame plans."""
