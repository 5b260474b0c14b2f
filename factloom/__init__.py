"""A PySpark-native engine for fact memory, with training-data operators in ``factloom.llm``."""
