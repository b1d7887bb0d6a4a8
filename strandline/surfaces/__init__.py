"""Command line, HTTP and tool surfaces: thin dispatch onto the operators over a folder of tables."""
