"""Lossless column codecs in numpy, and the binary blob container built from them."""
