"""Relational and temporal operators over posits."""
