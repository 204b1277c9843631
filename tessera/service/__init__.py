"""Databases by name, a command line and an HTTP interface."""
