"""Registered queries: one module for each area, each with QUERIES and ORACLES."""
