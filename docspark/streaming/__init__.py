"""Results in bounded batches, with cancellation and deadlines."""
