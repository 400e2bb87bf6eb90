"""Relational, spatial and temporal operators over catalogue tables."""
