"""Readers and writers: changelogs, commands, segments and the write-ahead log."""
