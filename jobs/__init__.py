"""Jobs with a command line: each is a function of a session and paths, run from the repository's top by ``python -m jobs.<name>``."""
