"""readlake: alignments of sequencing reads as read-centric tables, on Spark."""
