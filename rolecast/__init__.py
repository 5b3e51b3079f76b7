"""Match many profiles against many time-sensitive postings, as Spark jobs.

Every public function takes and returns DataFrames or Columns and stays lazy, so
Catalyst plans the whole flow. The few functions that run a job say so.
"""
