"""Results and uploads that pass piece by piece."""

from tessera.operators.results import iterate, stream_rows
from tessera.streaming.upload import Uploads

__all__ = ["Uploads", "iterate", "stream_rows"]
