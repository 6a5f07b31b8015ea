"""Operators for preparing training text: formatting, filtering, linking, sharding and packing."""
