"""The projection of the domain onto tables, and the query registry."""
