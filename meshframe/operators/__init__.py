"""DataFrame operators: curation, parameter vectors, geometry, losses, reports and checks."""
