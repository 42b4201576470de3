"""Set-oriented text forensics on Spark."""
