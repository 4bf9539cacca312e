"""Row-local column expressions; all run inside the JVM."""
