"""anisomap: direction-dependent (asymmetric) manifold learning on Spark DataFrames."""

__version__ = "0.1.0"
