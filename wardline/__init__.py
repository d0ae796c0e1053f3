"""wardline: tabular risk-modelling operators on Spark DataFrames.

Cleaning and lookup mapping of coded columns, ordinal / frequency / rare-level
/ one-hot encoding, code grouping, leak-free stratified splits and folds,
oversampling and SMOTE, class weights, population scaling, pyspark.ml models,
seeded search, evaluation metrics and attribution.  Every operator takes and
returns DataFrames; anything fitted is itself a small DataFrame.
"""

__version__ = "0.1.0"
