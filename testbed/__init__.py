"""Inventories and change records derived from the driver's tables, with queries and oracles."""
