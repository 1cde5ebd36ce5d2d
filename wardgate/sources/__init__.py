"""Scans.

Arrays are unnested with ``explode_outer`` and a filter on the element: the plain ``explode`` would
have the optimizer test the array's size in a pushed-down filter, and so parse every document twice.
"""
