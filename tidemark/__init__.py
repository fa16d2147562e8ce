"""Analysis of drifting-buoy tracks, gridded fields and forecasts on Spark."""
