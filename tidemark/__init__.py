"""Keyed-changelog analytics on PySpark: the latest operation per key decides."""
