"""Sources: files, git, overlays, configuration; parsers of Python and JavaScript."""
