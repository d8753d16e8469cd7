"""Column functions: key parsing, text, time and JSON helpers. No function here runs a job."""
