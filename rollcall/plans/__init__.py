"""Shared plan building blocks, derived input views and the registered queries."""
