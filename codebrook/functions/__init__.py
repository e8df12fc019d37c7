"""Column functions of the engine, in one place."""

from ..operators.encode import flat_codes, int8, nearest_code, tree_code
from ..operators.lut import dequantize, fake_quantize
from ..plans.layout import codebook_of

__all__ = ["codebook_of", "dequantize", "fake_quantize", "flat_codes", "int8", "nearest_code", "tree_code"]
