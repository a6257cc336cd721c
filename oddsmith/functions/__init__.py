"""Column functions: pricing, margins, staking, scores and special functions."""
