"""End-to-end jobs and the catalogue of registered queries."""
