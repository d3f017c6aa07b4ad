"""Spark jobs over stored web pages, their links, versions, subtitles and request logs."""
