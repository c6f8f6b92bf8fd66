"""Prismatica: attribution, simulation and resampling analytics planned as Spark DataFrames."""

__version__ = "0.1.0"
