"""Graph, token, multiset, sketch and similarity operators on DataFrames."""
