"""Dated cross-section research on Spark: every public function takes and returns DataFrames or Columns."""
