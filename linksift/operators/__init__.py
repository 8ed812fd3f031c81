"""Table-level operators: profiling, splitting, scaling, learning, evaluation, reports."""
