"""Fractional-hash sketches, lossless bit-stream coding and frame analytics on Spark DataFrames."""
