"""The session fixture is the one in ``tests/conftest.py``."""
