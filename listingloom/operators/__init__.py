"""Table jobs: every public function takes and returns DataFrames."""
