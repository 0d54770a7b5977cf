"""Runnable jobs over given tables: each is a function that takes a session and plain paths, with a command line."""
