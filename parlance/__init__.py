"""parlance: transcript analytics and speech-recognition evaluation on PySpark DataFrames."""

__version__ = "0.1.0"
