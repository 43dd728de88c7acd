"""Runnable jobs: each a function of a session and plain paths, a command line and a small configuration."""
