"""leafmill: document-corpus analytics as Spark jobs."""
