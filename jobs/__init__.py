"""Jobs with a command line: python -m jobs.<name> --help."""
