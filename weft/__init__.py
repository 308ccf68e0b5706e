"""weft: training-data preparation and transcript analytics on Spark."""
