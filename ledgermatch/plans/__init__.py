"""End-to-end plans, the derived test views and the query registry."""
