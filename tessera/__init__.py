"""tessera: text analytics, subword segmentation and corpus metrics as Spark plans."""

__version__ = "0.1.0"
