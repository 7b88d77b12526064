"""Data types, constants and relation schemas."""

from __future__ import annotations

#: Container dtypes and their bits (fixed values).
DTYPE_BITS = {
    "BOOL": 8, "F4": 4, "F6_E2M3": 6, "F6_E3M2": 6, "U8": 8, "I8": 8, "F8_E5M2": 8, "F8_E4M3": 8,
    "F8_E8M0": 8, "F8_E4M3FNUZ": 8, "F8_E5M2FNUZ": 8, "I16": 16, "U16": 16, "F16": 16, "BF16": 16,
    "I32": 32, "U32": 32, "F32": 32, "C64": 64, "F64": 64, "I64": 64, "U64": 64,
}
#: dtypes whose elements can be read as float32, and their numpy storage.
FLOATING = {"F32": "<f4", "F16": "<f2", "BF16": "<u2"}

CHUNK_ELEMENTS = 16_384
MINIMUM_ELEMENTS = 1024
INT8_MAX, INT4_MAX, INT4_LOW, INT4_HIGH = 127, 7, -8, 7
Q8_BLOCK, Q8_BLOCK_BYTES = 32, 34
NVFP4_BLOCK, FP4_MAX, FP8_MAX = 16, 6, 448
E5M2_MAX = 57344
#: Where binary16 begins to round to infinity.
F16_MAX = 65520.0
#: The smallest positive float32, 2**-149.
SMALLEST = 2.0**-149

CATALOG = "path string, tensor string, dtype string, shape array<bigint>, element_count bigint, byte_len bigint, data_start bigint, data_end bigint"
CHUNKS = "tensor string, chunk bigint, base_idx bigint, vals array<float>"
PAYLOAD = "tensor string, chunk bigint, bytes binary"


def element_count(shape: list[int]) -> int:
    """Product of the dimensions; a zero dimension makes the tensor empty before anything overflows."""
    if 0 in shape:
        return 0
    n = 1
    for d in shape:
        n *= d
        if n >= 1 << 64:
            raise TensorError("ShapeElementCountOverflow", f"shape {shape} has too many elements")
    return n


def byte_length(dtype: str, shape: list[int]) -> int:
    """Bytes of a tensor; its bits must fill whole bytes."""
    bits = element_count(shape) * DTYPE_BITS[dtype]
    if bits % 8 or bits // 8 >= 1 << 64:
        raise TensorError("TensorByteLengthOverflow", f"{dtype} {shape} has no whole byte length")
    return bits // 8


def check_layout(dtype: str, shape: list[int], byte_len: int) -> int:
    """Number of elements of a tensor whose bytes must be just those of its shape and type."""
    if byte_length(dtype, shape) != byte_len:
        raise TensorError("TensorByteLengthMismatch", f"{dtype} {shape} has {byte_length(dtype, shape)} bytes, not {byte_len}")
    return element_count(shape)


class TensorError(ValueError):
    """A violated rule: its code and what was found."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.detail = code, detail
