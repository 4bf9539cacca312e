"""Web-corpus curation and quality measurement as Spark DataFrame jobs."""
