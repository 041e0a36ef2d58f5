"""boxmeter: detection-evaluation analytics and data preparation as Spark plans.

Every operator is a function from DataFrames to a DataFrame.  The subpackage
``llm`` holds the operators for training data; nothing outside it imports it.
"""
