"""Batch operators. Every public function takes DataFrames plus parameters and returns a DataFrame."""
