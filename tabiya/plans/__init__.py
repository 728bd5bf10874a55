"""Queries registered with the driver, and the SQL each is held against."""
