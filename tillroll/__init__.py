"""tillroll — cleaning, customer/order/store marts and sales analysis of point-of-sale data on Spark.

Every operator takes DataFrames and returns a DataFrame built from Spark's own expressions.
"""

__version__ = "0.1.0"
