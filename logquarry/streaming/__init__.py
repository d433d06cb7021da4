"""Live logs: the batch parsers on streams of lines."""
