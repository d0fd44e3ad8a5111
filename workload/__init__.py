"""Registered queries over the driver's tables, with their SQL where SQL can say it."""
