"""Entities over streams."""
