"""Descriptions made from tables, and the registered queries over them."""

from boundsmith.plans import older_queries, queries, record_queries  # noqa: F401  (each registers its queries)
