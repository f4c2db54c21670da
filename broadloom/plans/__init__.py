"""Input fixtures and the catalogue of registered queries."""
