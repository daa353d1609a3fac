"""DataFrame operators: structure of books, library catalog, voices, conversion jobs, audio figures."""
