"""DataFrame to DataFrame operators the clustering plans are composed of."""
