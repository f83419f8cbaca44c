"""One entry for all operations: ``compute(name, ...)``."""

from __future__ import annotations

from loomgrid.meta import TensorError
from loomgrid.operators import contraction, convolution, fourier, matrix, pipeline, reduction, stencil


def einsum_with_path(equation: str, *tensors, path=None, strategy: str = "auto"):
    return contraction.einsum(equation, *tensors, path=path, strategy=strategy)


OPERATIONS = {
    "matmul": matrix.matmul, "batch_matmul": matrix.batch_matmul, "transpose": matrix.transpose, "add": matrix.add,
    "matmul_mixed_precision": matrix.matmul_mixed_precision, "matmul_sparse_aware": matrix.matmul_sparse_aware, "matmul_batch": matrix.matmul_pairs,
    "conv2d": convolution.conv2d, "conv3d": convolution.conv3d,
    "fft": fourier.fft, "ifft": fourier.ifft, "rfft": fourier.rfft, "fft2d": fourier.fft2d, "fft2d_pencil": fourier.fft2d_pencil,
    "einsum": contraction.einsum, "einsum_with_path": einsum_with_path, "tensordot": contraction.tensordot,
    "sum": reduction.sum, "mean": reduction.mean, "max": reduction.max, "min": reduction.min, "sum_kahan": reduction.sum_kahan, "mean_kahan": reduction.mean_kahan,
    "stencil_2d": stencil.stencil_2d, "jacobi_2d": stencil.jacobi_2d,
    "pipelined_matmul": pipeline.pipelined_matmul, "pipelined_allreduce": pipeline.pipelined_allreduce,
}


def compute(operation: str, *args, **options):
    """Run an operation by name."""
    if operation not in OPERATIONS:
        raise TensorError(f"unknown operation {operation}; there are {', '.join(OPERATIONS)}")
    return OPERATIONS[operation](*args, **options)
