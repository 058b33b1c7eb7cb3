"""storyloom: coding of interview transcripts and other free text on Spark DataFrames."""

__version__ = "0.1.0"
