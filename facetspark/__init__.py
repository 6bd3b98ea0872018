"""Point-cloud metrology on Spark, and training-data operators in ``facetspark.llm``."""

__version__ = "0.1.0"
