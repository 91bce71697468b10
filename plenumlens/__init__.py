"""plenumlens: speech-transcript analytics as PySpark DataFrame operators."""
