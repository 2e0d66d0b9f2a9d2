"""Registered queries over the provided tables, each with equivalent SQL where SQL can say it."""
