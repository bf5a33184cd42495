"""Operators over facts, entities and episodes."""
