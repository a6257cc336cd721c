"""DataFrame operators: coverage, books, cells, inference, protocol, fitting and reports."""
