"""DataFrame to DataFrame operators over paragraphs, scenes and vectors."""
