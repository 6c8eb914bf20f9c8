"""Registered queries over the driver's tables, with equivalent SQL."""

from factloom.plans import aligning, books, checks, closing, contexts, labels, overriding, promoting, reconciling, summaries, tables, targets

PARTS = (reconciling, tables, labels, summaries, checks, contexts, books, closing, overriding, targets, aligning, promoting)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
