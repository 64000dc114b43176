"""Every operator as a query over the provided tables, with the SQL it has to agree with."""

from millrace.catalog.registry import oracles, queries  # noqa: F401
