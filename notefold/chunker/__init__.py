"""From a note's bytes to its passages: a pure function, run by the chunk operators in Arrow batches."""
