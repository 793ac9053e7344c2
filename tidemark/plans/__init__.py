"""Registered queries: driver tables mapped to domain tables, plus oracle SQL."""
