"""Event sources: tables, recorded pages through the Python data source API, and resilience."""
