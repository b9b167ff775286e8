"""Brute-force versions that several tests hold results against."""

from test_setjoin import brute as components

__all__ = ["components"]
