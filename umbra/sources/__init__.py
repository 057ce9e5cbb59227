"""Tables, texts and files as DataFrames."""
