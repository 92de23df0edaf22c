"""Readers and writers of batches, jobs, results and logs."""
