"""Words of a text: runs of anything but the six ASCII white-space characters.

``bytes.split()`` without arguments cuts at exactly ``\\x20`` and ``\\x09`` to ``\\x0D``, and
``bytes.lower()`` lowers exactly A to Z, so both are used on UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: The same words for the JVM's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def raw_texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of each text, one at a time; a null gives empty bytes."""
    for text in column.cast(pa.binary()):
        yield text.as_py() or b""
