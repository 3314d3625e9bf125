"""Daily market-price, weather and crop-water analytics as PySpark DataFrame operators."""

__version__ = "0.1.0"
