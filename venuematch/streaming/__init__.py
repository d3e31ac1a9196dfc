"""Listings that keep arriving."""
