"""Operators over DataFrames: nearest neighbours, BM25, fusion, quantization, IVF, versions."""
