"""Small NumPy kernels for Arrow functions; they import no Spark."""
