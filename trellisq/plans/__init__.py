"""The SPARQL parser, its algebra and rewrites."""
