"""PDF files checked before they are read, and mended where their table of offsets is damaged.

The reader of sources.pdf does without that table; others do not. Mending
appends a new table to the file and changes nothing before it.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from folioloom.sources import pdf

STATES = "path string, state string, error string, content binary"


def problem(content: bytes, timeout: float = 10.0) -> str | None:
    """What is wrong with a file: not readable, no pages, no sound table of offsets, or not read in timeout seconds."""
    told: list[str | None] = []

    def look() -> None:
        try:
            pages = pdf.File(content).pages()
            starts = re.findall(rb"startxref\s+(\d+)", content)
            sound = starts and re.compile(rb"\s*(xref\b|\d+\s+\d+\s+obj\b)").match(content, int(starts[-1]))
            told.append("the file has no pages" if not pages else None if sound else "the table of offsets is damaged")
        except Exception as e:  # noqa: BLE001  any broken file
            told.append(f"{type(e).__name__}: {e}")

    thread = threading.Thread(target=look, daemon=True)
    thread.start()
    thread.join(timeout)
    return told[0] if told else f"not read in {timeout:g} seconds"


def mended(content: bytes) -> bytes:
    """content with a new table of the offsets at which its objects stand."""
    content = content[max(content.find(b"%PDF-"), 0) :]
    file = pdf.File(content)
    roots = [n for n, v in file.objects.items() if isinstance(v, dict) and v.get("Type") == "Catalog"]
    if not roots or not file.pages():
        raise ValueError("the file has no pages")
    own = max(file.objects) + 1
    places = file.places | {own: (len(content) + 1, 0)}
    rows = []
    for n in range(own + 1):
        kind, pair = (1, places[n]) if n in places else (2, file.held[n]) if n in file.held else (0, (0, 65535))
        rows.append(kind.to_bytes(1) + pair[0].to_bytes(8) + pair[1].to_bytes(4))
    table = b"".join(rows)
    head = b"<</Type/XRef/Size %d/Root %d 0 R/W[1 8 4]/Length %d>>" % (own + 1, roots[-1], len(table))
    return content + b"\n%d 0 obj\n%s\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % (own, head, table, len(content) + 1)


def checked(found: DataFrame, timeout: float = 10.0) -> DataFrame:
    """(path, state, error, content) of the PDF files of sources.files.files.

    state is ok, repaired (content is mended) or degraded (mending failed:
    content is as it was); error tells what was found.
    """

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                content = bytes(content)
                error, state = problem(content, timeout), "ok"
                if error is not None:
                    try:
                        content, state = mended(content), "repaired"
                    except Exception:  # noqa: BLE001  the error found first is told
                        state = "degraded"
                rows.append((path, state, error, content))
            yield pd.DataFrame(rows, columns=["path", "state", "error", "content"])

    return found.where("doc_type = 'pdf'").select("path", "content").mapInPandas(scan, STATES)
