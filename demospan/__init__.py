"""demospan: Spark jobs for robot-demonstration datasets.

Episodes, step frames, skill segments, traces and rollout results are plain DataFrames;
every operator is a function from DataFrames (or Columns) to DataFrames (or Columns).
"""
