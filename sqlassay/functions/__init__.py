"""Column expressions; nothing in here triggers a job or leaves the JVM."""
