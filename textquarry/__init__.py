"""Search over text corpora and chat logs, written as Spark DataFrame jobs."""
