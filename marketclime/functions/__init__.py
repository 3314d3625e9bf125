"""Column functions. None of them runs a job."""
