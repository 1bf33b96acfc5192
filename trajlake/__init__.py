"""Analytics over agent trajectories and reinforcement-learning data, on PySpark."""
