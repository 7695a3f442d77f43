"""DataFrame operators: kernel frames, keyed reductions, graph and iterative analytics."""
