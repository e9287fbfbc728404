"""Operators for preparing large text and vector collections. Nothing outside imports this subpackage."""
