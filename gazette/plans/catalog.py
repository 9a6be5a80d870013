"""All queries of the library and their SQL: importing this module registers them."""

from gazette.plans import extended, raw, registry, tuning  # noqa: F401

QUERIES, SQL = registry.QUERIES, registry.SQL
